"""The hash cache: a Parquet table keyed by file state, which a scan joins before it hashes, so that only misses are read."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncsift.schema import HASH_VERSION

SCHEMA = "key_hex string, size long, mtime_ticks long, hash_partial string, hash_full string, algorithm string, hash_version int, entry_mac string, last_seen long"


def _field(c: Column) -> Column:
    """With its length before it, so that neighbours can't run together."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)


def compute_key(path: Column, size: Column, mtime_ticks: Column) -> Column:
    return F.sha2(F.concat(F.lit("cache-key-v1|"), _field(path), _field(size), _field(mtime_ticks)).cast("binary"), 256)


def volume_file_key(volume_id: Column, file_id: Column, size: Column, mtime_ticks: Column, algorithm: str = "sha256", version: int = HASH_VERSION) -> Column:
    """The key by file identity: a renamed file keeps its hashes."""
    return F.sha2(F.concat(F.lit("volume-file-key-v1|"), *(_field(x) for x in (volume_id, file_id, size, mtime_ticks, F.lit(algorithm), F.lit(version)))).cast("binary"), 256)


def entry_mac() -> Column:
    """Over the columns that decide, as read."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("key_hex", "algorithm", "hash_version", "size", "mtime_ticks", "hash_full", "hash_partial")]
    return F.sha2(F.concat_ws("\n", F.lit("cache-mac-v1"), *fields).cast("binary"), 256)


def entries(hashed: DataFrame, now: int, algorithm: str = "sha256") -> DataFrame:
    """Cache rows of files with partial and full hashes."""
    rows = hashed.select(
        compute_key(F.col("path"), F.col("size"), F.col("mtime_ticks")).alias("key_hex"), "size", "mtime_ticks", F.col("partial").alias("hash_partial"), F.col("full").alias("hash_full"),
        F.lit(algorithm).alias("algorithm"), F.lit(HASH_VERSION).alias("hash_version"),
    )
    return rows.withColumn("entry_mac", entry_mac()).withColumn("last_seen", F.lit(now).cast("long"))


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The last seen row for each key; write it beside the old table, then swap the folders."""
    latest = Window.partitionBy("key_hex").orderBy(F.desc("last_seen"), F.desc("new_"))
    both = cache.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    return both.withColumn("r_", F.row_number().over(latest)).where("r_ = 1").drop("r_", "new_")


def entry(algorithm: str = "sha256") -> Column:
    """What is served of a row, and whether its MAC, algorithm and version are right."""
    right = (F.col("entry_mac") == entry_mac()) & (F.col("algorithm") == algorithm) & (F.col("hash_version") == HASH_VERSION)
    return F.struct("key_hex", "hash_partial", "hash_full", right.alias("right"))


def latest(cache: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """(key_hex, e): the last seen entry of each key."""
    return cache.select("last_seen", entry(algorithm).alias("e")).groupBy(F.col("e.key_hex").alias("key_hex")).agg(F.max_by("e", F.struct("last_seen", F.xxhash64("e"))).alias("e"))


def served(keyed: DataFrame) -> DataFrame:
    """known_partial and known_full of rows with an entry ``e`` or null; an entry that isn't right raises."""
    safe = lambda c: F.when(F.col("e").isNull() | F.col("e.right"), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("cache entry was altered: "), F.col("key_hex"))))
    return keyed.withColumns({"known_partial": safe("e.hash_partial"), "known_full": safe("e.hash_full")}).drop("e")


def lookup(files: DataFrame, cache: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """``files`` with key_hex, known_partial and known_full, null for a miss.

    A row whose MAC, algorithm or version isn't right raises if a file asks for it: it is never served. A key that the cache
    has twice is served by its last seen row.
    """
    keyed = files.withColumn("key_hex", compute_key(F.col("path"), F.col("size"), F.col("mtime_ticks")))
    return served(keyed.join(latest(cache, algorithm), "key_hex", "left"))


def default_path() -> str:
    """Where a user's cache lies: under $XDG_CACHE_HOME or the home folder's .cache."""
    base = os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache")
    return os.path.join(base, "syncsift", f"hashes-v{HASH_VERSION}")


def validate(cache: DataFrame) -> None:
    """Raise unless the table has the columns and types of SCHEMA, and no entry of another hash version."""
    want = [tuple(x.split()) for x in SCHEMA.replace("long", "bigint").split(", ")]
    if [(n, t) for n, t in cache.dtypes] != want:
        raise ValueError(f"not a hash cache: {cache.dtypes}")
    other = cache.where(F.coalesce(F.col("hash_version"), F.lit(-1)) != HASH_VERSION).select("hash_version").first()
    if other is not None:
        raise ValueError(f"a hash cache of version {other[0]}, not {HASH_VERSION}")
