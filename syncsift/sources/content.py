"""A table of file contents laid out by candidate groups, so that a scan opens only the files that hold members.

``store`` writes two Parquet tables into a folder. ``metadata`` has the inventory's columns, and where each content lies. ``content``
is partitioned by ``lone`` (no other readable file has the (base, size) of this one) and ``part`` (a hash of (base, size)), so
that a group's members lie together and apart from the many files that are in no group. Which files are lone comes
from metadata alone; contents move once, by path, when they are stored.

``Store.contents`` reads the contents of some paths: the paths' places, at most twice the number of parts, become a filter on the
partition columns, and Spark lists and opens no other file. A file that was stored as lone and has met its like since lies where it
was: its part of the lone files is read, until ``compacted`` lays all out anew.

Defined results: a path that is stored twice is the last one's (by ``added``); a placeholder's content isn't stored; null contents are kept
as they are; an empty store has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syncsift.functions import placeholders
from syncsift.operators import verdicts

PARTS = 256
_PLACE = ("lone", "part")
CONTENT = "path string, size long, content binary, added long, lone boolean, part int"


@dataclass
class Store:
    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        read = self.spark.read.schema(CONTENT) if name == "content" else self.spark.read
        return read.parquet(f"{self.folder}/{name}")

    @property
    def metadata(self) -> DataFrame:
        """The inventory: the last row of each path."""
        rows = self._table("metadata")
        last = rows.groupBy("path").agg(F.max("added").alias("added"))
        return rows.join(last, ["path", "added"]).drop("added", *_PLACE)

    def contents(self, wanted: DataFrame) -> DataFrame:
        """(path, size, content) of the stored rows that lie where the paths of ``wanted`` do: those, and some beside them."""
        rows = self._table("metadata")
        last = rows.groupBy("path").agg(F.max("added").alias("added"))
        places = rows.join(last, ["path", "added"]).join(wanted.select("path"), "path", "left_semi").groupBy(*_PLACE).agg(F.max("added").alias("added")).collect()
        held = {lone: sorted(r["part"] for r in places if r["lone"] == lone) for lone in (False, True)}
        here = F.lit(False)
        for lone, parts in held.items():
            if parts:
                here = here | ((F.col("lone") == lone) & F.col("part").isin(parts))
        found = self._table("content").where(here)
        return found.join(last, ["path", "added"]).select("path", "size", "content") if self._replaced(rows) else found.select("path", "size", "content")

    @staticmethod
    def _replaced(rows: DataFrame) -> bool:
        """Whether some path was stored more than once."""
        return not rows.groupBy("path").count().where("count > 1").isEmpty()


def _placed(rows: DataFrame, known: DataFrame | None, parts: int) -> DataFrame:
    """(path, lone, part) of metadata rows, among themselves and the rows ``known``."""
    kind = placeholders.classify(F.col("attributes"), F.col("placeholder_kind"))
    readable = lambda df: verdicts.with_base(df.where(~placeholders.is_placeholder(F.col("attributes"), kind)).select("path", "size"))
    every = readable(rows) if known is None else readable(rows).unionByName(readable(known))
    counts = every.distinct().groupBy(*verdicts.KEY).agg((F.count("*") < 2).alias("lone"))
    part = F.pmod(F.xxhash64(*verdicts.KEY), F.lit(parts)).cast("int")
    return readable(rows).distinct().join(counts, list(verdicts.KEY)).select("path", "lone", part.alias("part"))


def store(rows: DataFrame, folder: str, added: int = 0, parts: int = PARTS) -> Store:
    """Write, or append to, the store in ``folder``: inventory rows with a content column; ``added`` orders stores of one path."""
    spark = rows.sparkSession
    here = Store(spark, folder)
    metadata = rows.drop("content")
    known = here.metadata if _exists(spark, f"{folder}/metadata") else None
    places = _placed(metadata, known, parts)
    placed = metadata.join(places, "path", "left").withColumn("added", F.lit(added).cast("long"))
    contents = rows.select("path", "size", "content").join(places, "path").withColumn("added", F.lit(added).cast("long"))
    # Contents first: metadata that names a place has its content there, also if the job ends between the two.
    contents.hint("rebalance", *_PLACE).write.mode("append").partitionBy(*_PLACE).parquet(f"{folder}/content")
    placed.write.mode("append").parquet(f"{folder}/metadata")
    return here


def compacted(old: Store, folder: str, parts: int = PARTS) -> Store:
    """The same rows in another folder, laid out by the groups that there are now."""
    last = old._table("metadata").groupBy("path").agg(F.max("added").alias("added"))
    contents = old._table("content").join(last, ["path", "added"]).select("path", "content")
    return store(old.metadata.join(contents, "path", "left"), folder, parts=parts)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
