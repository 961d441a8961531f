"""Line dedup: lines that many documents share stay in one document only.

A line's key is the line without the bytes ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case. Keys of at
least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines, except in the largest
doc_id holding it. Normalised lines are exploded once per document and hashed to 128 bits; documents per hash are
counted with a partial count before the shuffle, so a line that a third of all documents hold is a few rows per task.
The frequent hashes are joined back on the hash (a join of two exchanges, which adaptive execution splits where a
hash is hot), gathered per document, and the lines that stay are joined by position inside the row.

Defined results: a null or empty text is one empty line; a null doc_id is kept, counts as a document of its own id null
and never is the largest; rows that repeat a doc_id count as one document; an empty table gives no rows; other columns
of the input are ignored. Documents move between tasks once, and only those that hold a frequent line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncsift.llm.common import dropped, only, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def hash_of(key: Column) -> Column:
    """128 bits of a key."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b"))


def long_enough(line: Column, min_chars: int) -> Column:
    return F.char_length(F.btrim(line, F.lit(SPACE))) >= min_chars


def frequent_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, drop), written: for each document that loses lines, the hashes of their keys."""
    lines = only(docs, "doc_id", "text").select(
        "doc_id",
        F.explode(F.array_distinct(F.transform(F.filter(lines_of(F.col("text")), lambda x: long_enough(x, min_chars)), lambda x: hash_of(key_of(x))))).alias("h"),
    ).select("doc_id", F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    lines = written(lines)
    # Rows that repeat a doc_id count once: documents are the distinct (hash, doc_id).
    once = lines.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))
    frequent = written(once.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("kept_in")).where(F.col("n") >= min_docs).select("a", "b", "kept_in"))
    hits = lines.join(frequent.hint("merge"), ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("kept_in")))
    out = written(hits.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("drop")))
    for table in (lines, frequent):
        dropped(table)
    return out


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, kept string, n_lines long, n_dropped long, and the columns ``carry``) for every row of ``docs``."""
    drops = frequent_lines(docs, min_chars, min_docs).withColumnRenamed("doc_id", "loser")
    every = only(docs, "doc_id", "text", *carry).toDF("doc_id", "text", *(f"carried{i}" for i in range(len(carry))))  # whatever their names
    all_lines = lines_of(F.col("text"))
    kept = F.filter(F.col("l"), lambda x: ~(long_enough(x, min_chars) & F.array_contains(F.col("drop"), hash_of(key_of(x)))))
    joined = every.join(drops.hint("merge"), F.col("doc_id").eqNullSafe(F.col("loser")), "left").withColumn("l", all_lines)
    return joined.withColumn("k", F.when(F.col("drop").isNull(), F.col("l")).otherwise(kept)).select(
        "doc_id",
        F.array_join("k", "\n").alias("kept"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size("k")).cast("long").alias("n_dropped"),
        *(F.col(f"carried{i}").alias(c) for i, c in enumerate(carry)),
    )


def digest(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line, lower_key AS k FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
  , LATERAL (SELECT translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key)),
frequent AS (SELECT k, max(doc_id) AS kept_in FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND l.doc_id <> f.kept_in AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
