"""Tables written in the folder that all executors share, to cut lineage or to use a result more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROW_GROUP = 16 << 20  # bytes; a task holds one in memory while it writes
_held: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where that is unset and executors are threads of this process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = set_.get() if set_.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="readmill-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended first; the folder is temporary anyway
        pass


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes folders of any store that Spark reads; those that aren't there are passed over."""
    for path in paths:
        _drop(spark, path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes with `release`, or when the driver's Python ends."""
    path = f"{shared_dir(spark)}/readmill-{uuid.uuid4().hex}"
    if not _held:
        atexit.register(release, spark)
    _held.append(path)
    return path


def materialized(df: DataFrame) -> DataFrame:
    """df as a Parquet table, read again; see `scratch`."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Drops the tables written so far. For long sessions, once the results made from them are written."""
    while _held:
        _drop(spark, _held.pop())
