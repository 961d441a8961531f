"""Tables that a plan writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local master, whose driver and executors are one process, may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="syncsift-"))
        atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
    return f"file://{_local_dir[0]}"


def written(df: DataFrame, *, cleanup: bool = True) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends, and the work is done once.

    The shuffle files behind it are given back, since the table replaces them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/syncsift/{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    if cleanup:
        spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        if cleanup:
            spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._syncsift_path = path  # for dropped()
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of written() that no later plan reads."""
    spark, path = df.sparkSession, df._syncsift_path
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
