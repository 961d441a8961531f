"""What a later scan has to look at: changes between two inventories, and inventories that arrive as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from syncsift.functions import placeholders
from syncsift.operators import verdicts


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, removed, or changed in size or time. One shuffle of metadata on the path."""
    b, a = before.select("path", F.struct("size", "mtime_ticks").alias("b")), after.select("path", F.struct("size", "mtime_ticks").alias("a"))
    kind = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, "path", "full_outer").select("path", kind.alias("change")).where("change is not null")


def stream_groups(spark: SparkSession, folder: str, schema, out: str, checkpoint: str) -> StreamingQuery:
    """Count members of (base, size) over inventory files as they arrive; ``latest_groups`` reads the counts of all groups so far.

    Each batch writes a whole view: the one before, with the groups that the batch touched in place of theirs. A batch that
    is run again after a failure writes the same view. Views older than the last two are deleted. The state holds a row
    for each group, as the view does: an inventory has no time after which a group could be forgotten.
    """
    rows = spark.readStream.schema(schema).parquet(folder)
    counts = verdicts.with_base(placeholders.split(rows)[0]).groupBy(*verdicts.KEY).agg(F.count("*").alias("members"))

    def keep(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last = [n for n in _views(session, out) if n < number]
        touched = batch.persist()
        view = touched
        if last:
            before = session.read.schema(batch.schema).parquet(f"{out}/view={last[-1]}")
            view = before.join(touched, list(verdicts.KEY), "left_anti").unionByName(touched)
        view.write.mode("overwrite").parquet(f"{out}/view={number}")
        touched.unpersist()
        for old in last[:-1]:
            _folder(session, out)[0].delete(_path(session, f"{out}/view={old}"), True)

    return counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _folder(spark: SparkSession, out: str):
    where = _path(spark, out)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _views(spark: SparkSession, out: str) -> list[int]:
    """The numbers of the views that are whole, in order."""
    files, where = _folder(spark, out)
    if not files.exists(where):
        return []
    names = [f.getPath() for f in files.listStatus(where) if f.getPath().getName().startswith("view=")]
    return sorted(int(p.getName().removeprefix("view=")) for p in names if files.exists(_path(spark, f"{p.toString()}/_SUCCESS")))


def latest_groups(spark: SparkSession, out: str) -> DataFrame:
    """(base, size, members) after the last batch."""
    views = _views(spark, out)
    if not views:
        return spark.createDataFrame([], "base string, size long, members long")
    return spark.read.parquet(f"{out}/view={views[-1]}")
