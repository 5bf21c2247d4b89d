"""Intermediate tables in the folder that every executor can reach.

The folder is the session's ``spark.checkpoint.dir``, or the one given to
``setCheckpointDir``. Unlike cached blocks, a
table written there survives the loss of executors, and it cuts the lineage.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; an error where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder.rstrip('/')}/salesmart/{spark.sparkContext.applicationId}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the stored table, for results that several jobs read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(stored: DataFrame) -> None:
    """Delete one settled table; its maker calls this when the last reader is done."""
    for folder in {file.rsplit("/", 1)[0] for file in stored.inputFiles()}:
        _delete(stored.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Delete this session's intermediate tables; call it when their readers are done."""
    _delete(spark, shared_folder(spark))
