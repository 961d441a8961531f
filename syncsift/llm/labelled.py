"""Labelled rows for the classifiers: a bounded sample, joined to whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncsift.llm.common import crc_fold, only


def sample(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """(doc_id, fold int, y int, text) of at most ``most`` labelled documents whose fold, crc32(doc_id as text) mod 5, isn't 0.

    The sample is that of the smallest hashes of doc_id, so it is the same at each run. It has ``most`` rows of three
    small numbers at most, and so can be broadcast to where the documents are.
    """
    rows = only(labels, "doc_id", target).where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).alias("y"))
    rows = rows.withColumn("fold", crc_fold().cast("int")).where("fold <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return only(docs, "doc_id", "text").join(F.broadcast(rows), "doc_id")
