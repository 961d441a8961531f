"""A training-data pipeline over ``documents``: quality, line dedup, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of ``documents``, with n_chars as the text now is. Labels are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syncsift.llm import line_dedup, near_copies, packing, quality, suffix_dedup
from syncsift.llm.common import dropped, written
from syncsift.shipping import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null text is scored as an empty one; rows that repeat a doc_id, or that are equal, are scored each; a null doc_id doesn't matter; long texts
    are scored whole; an empty table stays empty. Labels without a document, or with nulls, teach nothing.
    """
    docs = docs.select(*COLUMNS)
    return quality.accepted(docs, quality.fit(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in the last of them only; documents that lose all their text go.

    A null text becomes an empty one; rows that repeat a doc_id count as one document; a null doc_id is kept.
    """
    ship(spark)
    kept = line_dedup.line_dedup(docs, carry=("lang", "source"))
    return _with_text(kept.where((F.col("n_dropped") == 0) | (F.length(F.btrim("kept", F.lit(line_dedup.SPACE))) > 0)), "kept")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) stays: that with the smallest doc_id.

    SimHash retrieves the texts that are compared, MinHash bands those whose fingerprints are further apart.

    A null text counts as an empty one, and all texts without words are one group; of rows that are equal one stays; a row with a null doc_id
    stays only if its group has no other; texts are compared whole, whatever their length; an empty table stays empty. Only the columns of
    ``documents`` are handed on, so others can't clash.
    """
    ship(spark)
    return near_copies.near_dedup(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, and strings of 400 bytes, that occur elsewhere go; documents that lose all their text go.

    Each occurrence goes, as op3's contract has it; a character that would lose only some of its bytes stays.
    """
    ship(spark)
    return _with_text(suffix_dedup.without_repeats(docs.select(*COLUMNS)), "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    A null or empty text is the one token that ends a document; rows that repeat a doc_id are documents of their own; a long text is as many
    pieces as it needs, and no id is in two; an empty table gives no rows; columns but doc_id and text are ignored.
    """
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("line dedup", drop_lines), ("SimHash near-dedup", drop_near_copies), ("suffix-array dedup", drop_passages), ("packing", pack)]

#: SQL can't express the classifier or the tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
