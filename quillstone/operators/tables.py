"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; below one of our own only where that is unset, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        found = "/tmp/checkpoints/quillstone"
    return f"{(found if ':' in found else f'file://{found}').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before us; the folder belongs to it
        return


def temporary_folder(spark: SparkSession, name: str) -> str:
    """The same, deleted when the program ends."""
    path = shared_folder(spark, name)
    atexit.register(_drop, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read again: their lineage ends there, and lost executors cost no earlier work."""
    path = temporary_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys into several parts a core: a small file of many rows is one part, and one task would do all that follows.

    The number is given, as Spark would put small parts together again.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
