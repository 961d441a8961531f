"""Versions on disk, side by side: pairs of paths, routed by the left one's name to a comparison of lines or of bytes.

Bytes are compared by ranges: each range of a pair is one task's, which reads both files in pieces and stops at the first difference; a
pair's first difference is the least of its ranges'. So files may be larger than memory, and a large pair is many tasks' work.
Lines need both texts at hand: a text larger than ``most_text`` is compared by bytes, too, and says so in ``comparison``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syncsift.functions.hashing import PIECE, RANGE
from syncsift.operators import compare

FOUND = T.StructType([T.StructField("offset", T.LongType()), T.StructField("error", T.StringType())])
SIZES = T.StructType([T.StructField("left", T.LongType()), T.StructField("right", T.LongType()), T.StructField("error", T.StringType())])
LINES = T.StructType([T.StructField("regions", T.ArrayType(compare.REGION)), T.StructField("error", T.StringType())])


@F.pandas_udf(SIZES)
def _sizes(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    def one(x, y):
        try:
            return os.stat(x).st_size, os.stat(y).st_size, None
        except OSError as e:
            return None, None, str(e)

    return pd.DataFrame([one(x, y) for x, y in zip(left, right, strict=True)], columns=SIZES.names).astype({"left": "Int64", "right": "Int64"})


def difference(left: str, right: str, start: int, n: int) -> int | None:
    """The offset of the first byte in which two files differ, of the n bytes from ``start``; None if there is none."""
    with open(left, "rb", buffering=0) as f, open(right, "rb", buffering=0) as g:
        f.seek(start)
        g.seek(start)
        at = start
        while at < start + n:
            size = min(PIECE, start + n - at)
            x, y = _exactly(f, size, left), _exactly(g, size, right)
            if x != y:
                return at + next(i for i in range(size) if x[i] != y[i])
            at += size
    return None


def _exactly(f, n: int, path: str) -> bytes:
    data = f.read(n)
    while len(data) < n:
        more = f.read(n - len(data))
        if not more:
            raise OSError(f"{path} has become shorter")
        data += more
    return data


@F.pandas_udf(FOUND)
def _difference(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for columns in batches:
        rows = []
        for left, right, start, n in zip(*columns, strict=True):
            try:
                rows.append((difference(left, right, int(start), int(n)), None))
            except OSError as e:
                rows.append((None, str(e)))
        yield pd.DataFrame(rows, columns=FOUND.names).astype({"offset": "Int64"})


@F.pandas_udf(LINES)
def _lines(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    def text(path):
        with open(path, "rb") as f:
            return compare.lines_of(compare.decode(f.read()))

    for columns in batches:
        rows = []
        for kind, left, right in zip(*columns, strict=True):
            try:
                found = compare.BY_KIND[kind](text(left), text(right))
                rows.append(([dict(zip(compare.REGION.names, r, strict=True)) for r in found], None))
            except OSError as e:
                rows.append((None, str(e)))
        yield pd.DataFrame(rows, columns=LINES.names)


def byte_regions(pairs: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """``pairs`` (left, right, sizes) with regions, of at most one, and error: Changed at the first difference, else one side's whole surplus."""
    low = F.least("sizes.left", "sizes.right")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), low - 1), F.lit(range_bytes).cast("long"))
    dealt = pairs.select("left", "right", low.alias("low"), F.explode(starts).alias("start")).repartition("left", "right", "start")
    found = dealt.withColumn("f", _difference.asNondeterministic()("left", "right", "start", F.least(F.lit(range_bytes).cast("long"), F.col("low") - F.col("start"))))
    first = found.groupBy("left", "right").agg(F.min("f.offset").alias("offset"), F.min("f.error").alias("read_error"))
    joined = pairs.join(first, ["left", "right"], "left")
    n, m = F.col("sizes.left"), F.col("sizes.right")

    def region(kind: str, at, a, b):
        names = ("left_start", at), ("left_count", a), ("right_start", at), ("right_count", b)
        return F.array(F.struct(F.lit(kind).alias("kind"), *(c.cast("long").alias(x) for x, c in names)))

    one, none = F.lit(1), F.lit(0)
    regions = (
        F.when(F.col("offset").isNotNull(), region(compare.CHANGED, F.col("offset"), one, one))
        .when(n > m, region(compare.REMOVED, m, n - m, none))
        .when(m > n, region(compare.ADDED, n, none, m - n))
        .otherwise(F.array().cast(T.ArrayType(compare.REGION)))
    )
    error = F.coalesce("sizes.error", "read_error")
    return joined.withColumn("error", error).withColumn("regions", F.when(error.isNull(), regions)).drop("offset", "read_error")


def compare_files(pairs: DataFrame, most_text: int = 64 << 20, range_bytes: int = RANGE) -> DataFrame:
    """(left, right, comparison, regions array<REGION>, error) of distinct pairs of paths; a file that can't be read is an error, with null regions."""
    kind = compare.comparator(F.col("left"))
    sized = pairs.select("left", "right").distinct().withColumn("sizes", _sizes.asNondeterministic()("left", "right"))
    large = F.greatest("sizes.left", "sizes.right") > most_text
    sized = sized.withColumn("comparison", F.when(F.coalesce(large, F.lit(False)), "binary").otherwise(kind))
    lines = sized.where("comparison <> 'binary'").withColumn("l", _lines.asNondeterministic()("comparison", "left", "right"))
    out = ("left", "right", "comparison", "regions", "error")
    texts = lines.withColumns({"regions": F.col("l.regions"), "error": F.col("l.error")}).select(*out)
    return texts.unionByName(byte_regions(sized.where("comparison = 'binary'"), range_bytes).select(*out))
