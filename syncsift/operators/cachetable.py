"""The hash cache as a folder of tables: a bucketed base, appended deltas that are merged on read, and a version file that is written last.

``version-<n>.json`` names the base and the deltas that count, their hash version and the number of entries of each; the largest n is
the cache. A writer writes its table first and then its version file, by a rename that fails if the number is taken: a writer that
dies between leaves a folder that no version names, and of two writers at once the second one raises and loses nothing.

The base has an entry for each key, bucketed and sorted by it, so a lookup shuffles the files that ask, not the base. Deltas hold
what later scans read, and are small; ``compact`` merges them into a new base. The tables before stay until ``vacuum``, for scans that
still read them.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syncsift.operators import cache
from syncsift.schema import HASH_VERSION

BUCKETS, MOST_DELTAS = 64, 8
LAYOUT = 1


@dataclass
class Version:
    number: int = 0
    layout: int = LAYOUT
    hash_version: int = HASH_VERSION
    buckets: int = BUCKETS
    base: str | None = None
    deltas: list[str] = field(default_factory=list)
    entries: dict[str, int] = field(default_factory=dict)  # rows of each table, for the check on opening


class CacheTable:
    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS):
        """``folder`` may lie in any store that Spark writes; by default the user's cache. Raises if it holds something else."""
        self.spark, self.folder, self.buckets = spark, (folder or f"file://{cache.default_path()}").rstrip("/"), buckets
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version = self._current()
        self._checked()

    # ---- files

    def _names(self) -> list[str]:
        top = self._path(self.folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def _current(self) -> Version:
        names = self._names()
        numbers = [int(m[1]) for m in map(re.compile(r"version-(\d+)\.json").fullmatch, names) if m]
        if not numbers:
            if any(not re.fullmatch(r"(base|delta|\.version)-.*", n) for n in names):
                raise ValueError(f"not a hash cache: {self.folder}")
            return Version(buckets=self.buckets)
        text = self.spark.read.text(f"{self.folder}/version-{max(numbers):08d}.json", wholetext=True).first()[0]
        try:
            found = Version(**json.loads(text))
        except (TypeError, ValueError) as e:
            raise ValueError(f"a version file of the hash cache is broken: {e}") from e
        if (found.layout, found.hash_version) != (LAYOUT, HASH_VERSION):
            raise ValueError(f"a hash cache of version {found.hash_version}, layout {found.layout}, not {HASH_VERSION} and {LAYOUT}")
        return found

    def _commit(self, version: Version) -> None:
        beside = self._path(f"{self.folder}/.version-{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(asdict(version), indent=1).encode()))
        out.close()
        last = self._path(f"{self.folder}/version-{version.number:08d}.json")
        if self._fs.exists(last) or not self._fs.rename(beside, last):
            self._fs.delete(beside, False)
            raise RuntimeError(f"another writer has committed version {version.number} of {self.folder}; its entries stay, these are lost")
        self.version = version

    # ---- tables

    def _base(self) -> DataFrame:
        """Read through an external table, since only a table tells Spark of its buckets."""
        name = "syncsift_" + re.sub(r"\W", "_", self.version.base)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cache.SCHEMA}) USING parquet CLUSTERED BY (key_hex) SORTED BY (key_hex) INTO {self.version.buckets} BUCKETS LOCATION '{self.folder}/{self.version.base}'")
        return self.spark.table(name)

    def _deltas(self) -> DataFrame | None:
        paths = [f"{self.folder}/{d}" for d in self.version.deltas]
        return self.spark.read.schema(cache.SCHEMA).parquet(*paths) if paths else None

    def _checked(self) -> None:
        """Raise if a table that the version names is gone or has not the rows that it had: a cache is served whole or not at all."""
        for name, rows in self.version.entries.items():
            path = f"{self.folder}/{name}"
            if not self._fs.exists(self._path(path)):
                raise ValueError(f"the hash cache has lost {path}")
            found = self.spark.read.parquet(path)
            want = [tuple(x.split()) for x in cache.SCHEMA.replace("long", "bigint").split(", ")]
            if [(n, t) for n, t in found.dtypes] != want or found.count() != rows:
                raise ValueError(f"the hash cache was altered: {path}")

    def entries(self) -> DataFrame:
        """The last seen entry of each key."""
        deltas = self._deltas()
        if self.version.base is None:
            empty = self.spark.createDataFrame([], cache.SCHEMA)
            return empty if deltas is None else cache.upsert(empty, deltas)
        return self._base() if deltas is None else cache.upsert(self._base(), deltas)

    def lookup(self, files: DataFrame, algorithm: str = "sha256") -> DataFrame:
        """As cache.lookup: ``files`` with key_hex, known_partial and known_full. Neither base nor deltas are merged for it."""
        keyed = files.withColumn("key_hex", cache.compute_key(F.col("path"), F.col("size"), F.col("mtime_ticks")))
        found = []
        if (deltas := self._deltas()) is not None:
            keyed = keyed.join(cache.latest(deltas, algorithm).withColumnRenamed("e", "new_"), "key_hex", "left")
            found.append(F.col("new_"))
        if self.version.base is not None:
            keyed = keyed.join(self._base().select("key_hex", cache.entry(algorithm).alias("old_")), "key_hex", "left")
            found.append(F.col("old_"))
        if not found:
            return keyed.withColumns({c: F.lit(None).cast("string") for c in ("known_partial", "known_full")})
        return cache.served(keyed.withColumn("e", F.coalesce(*found)).drop("new_", "old_"))

    # ---- changes

    def append(self, new: DataFrame) -> CacheTable:
        """Add entries as a delta; the base grows by ``compact``, which the delta over MOST_DELTAS calls."""
        name = f"delta-{uuid.uuid4().hex}"
        new.select([x.split()[0] for x in cache.SCHEMA.split(", ")]).write.parquet(f"{self.folder}/{name}")
        rows = self.spark.read.schema(cache.SCHEMA).parquet(f"{self.folder}/{name}").count()
        now = self.version
        self._commit(Version(now.number + 1, base=now.base, buckets=now.buckets, deltas=[*now.deltas, name], entries=now.entries | {name: rows}))
        return self.compact() if len(self.version.deltas) > MOST_DELTAS else self

    def compact(self) -> CacheTable:
        """One new base of all entries."""
        name, table = f"base-{uuid.uuid4().hex}", f"syncsift_new_{uuid.uuid4().hex}"
        every = self.entries().repartition(self.buckets, "key_hex")
        every.write.bucketBy(self.buckets, "key_hex").sortBy("key_hex").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(table)
        rows = self.spark.table(table).count()
        self.spark.sql(f"DROP TABLE {table}")  # an external one: its files stay
        self._commit(Version(self.version.number + 1, base=name, buckets=self.buckets, entries={name: rows}))
        return self

    def vacuum(self) -> list[str]:
        """Delete what the present version doesn't name: tables and versions of before, and what dead writers left. No scan may be reading."""
        keep = {f"version-{self.version.number:08d}.json", self.version.base, *self.version.deltas}
        gone = [n for n in self._names() if n not in keep and re.fullmatch(r"(base|delta|\.?version)-.*", n)]
        for n in gone:
            self._fs.delete(self._path(f"{self.folder}/{n}"), True)
        return gone
