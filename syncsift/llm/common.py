"""What the operators share: written tables in the shared folder, columnar batch access, grouped streaming."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syncsift.tables import dropped, written  # noqa: F401  the operators take them from here


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which the cluster sets by its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: extra columns, also some with clashing names, stay out of the plans."""
    return df.select(*names)


def binary_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of ``column``, one row at least, to bound a worker's memory."""
    for batch in batches:
        _, at = binary_of(batch.column(column))
        start = 0
        while start < len(batch):
            end = int(np.searchsorted(at, at[start] + most, side="right")) - 1
            end = min(max(end, start + 1), len(batch))
            yield batch.slice(start, end - start)
            start = end


def by_key(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """(key, first, piece) of batches that are sorted by ``keys``; a group's rows come in pieces and are never held together here."""
    last = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(batch), bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [*np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            yield key, key != last, batch.slice(a, b - a)
            last = key


def dealt(df: DataFrame, keys: list[str], then: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Rows with equal keys in one task, sorted by keys and ``then``, for a mapInArrow that streams over groups."""
    n = n or partitions(df.sparkSession)
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *(then or []))


Pass = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def arrow(function: Pass, df: DataFrame, schema: str) -> DataFrame:
    return df.mapInArrow(released(function), schema)


def released(function: Pass) -> Pass:
    """The function for mapInArrow, which gives free memory back to the system at a task's end: workers are kept for later tasks."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return run


def release() -> None:
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def usable_vectors(df: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(id long, v array<double>) of the rows whose vector has no null or non-finite component (and isn't all zero, if asked)."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite)
    if nonzero:
        good = good & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.coalesce(good, F.lit(False)))


def vector_rows(df: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(rid, id, v), written: a row for each usable vector. rid numbers rows, so that rows that repeat an id stay apart."""
    return written(usable_vectors(only(df, id_col, vec_col), id_col, vec_col, nonzero).withColumn("rid", F.monotonically_increasing_id()))


def by_length(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """[(length, places, matrix)] of an array<double> column without nulls."""
    if not len(column):
        return []
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy().astype(np.int64))
    size = np.diff(ends, prepend=0)
    if (size == size[0]).all():
        return [(int(size[0]), np.arange(len(column)), flat.reshape(len(column), -1))]
    out = []
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        out.append((n, rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]))
    return out


def crc_fold(column: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 5."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


SALTS = 8  # parts that the neighbours of one node are dealt to


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): for each node with an edge, the smallest node that it reaches. edges: (a, b) of long.

    Alternates large-star and small-star steps, each a grouped minimum that is combined before it is shuffled and a
    join on the node and a salt of the neighbour, so that a node with very many neighbours is no single task's; each
    round is a written table.
    """
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt")
    each = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), each)
        large = both.where("v > u").select("u", "v", salt).join(least.hint("merge"), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.select("u", "v", salt).join(below.select("u", "m", each).hint("merge"), ["u", "salt"]).select(F.col("v").alias("x"), F.col("m").alias("y"))
        small = small.unionByName(below.select(F.col("u").alias("x"), F.col("m").alias("y")))
        small = written(small.where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct())
        tally = small.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % F.lit(1 << 40))).first()
        dropped(now)
        dropped(large)
        now = small
        if tally == seen:
            break
        seen = tally
    else:
        raise RuntimeError("components did not converge")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = written(labels.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))
    dropped(now)
    return out
