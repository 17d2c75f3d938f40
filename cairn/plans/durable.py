"""Tables in the shared folder: lineage cuts that outlive executors.

A cut is a Parquet table in the folder that the session names in
``spark.checkpoint.dir``: it is computed once, survives lost executors and is
read again with column pruning. Tables are removed when the driver ends.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where tables go if the session names no shared folder and runs on one machine (tests).
LOCAL_ROOT = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The shared folder; on a cluster it must be named."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return (root or LOCAL_ROOT).rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/cairn/{name}-{uuid.uuid4().hex}"
    fs, where = hadoop_path(spark, path)
    fs.deleteOnExit(where)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, object]):
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def durable(df: DataFrame, name: str = "table", **more) -> DataFrame:
    """df, written to the shared folder and read again; shuffle files behind it go once it is written. more: further settings while it is written."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | more):
        df.write.option("compression", "zstd").parquet(path)
    return reread(spark, df, [path])


def reread(spark: SparkSession, like: DataFrame, paths: list[str]) -> DataFrame:
    """The tables at the paths as one, whatever their number."""
    out = spark.read.schema(like.schema).parquet(*paths)
    out.stored_at = paths
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the tables of durable() that nothing reads any more."""
    for path in df.stored_at:
        fs, where = hadoop_path(df.sparkSession, path)
        fs.delete(where, True)
