"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without a checkpoint folder gets one of its own, once."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="salesmart-llm-"))
        named = context.getCheckpointDir()
    return f"{named.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


_on_the_way: ContextVar[list[str] | None] = ContextVar("_on_the_way", default=None)  # what settle_alone will delete
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the stored table: lineage ends here and survives lost executors.

    The write's own shuffle files are deleted when it has ended.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid4().hex}"
    if (noted := _on_the_way.get()) is not None:
        noted.append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settle_alone(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Settle what ``build`` returns, and delete the tables that it settled on the way.

    Only tables settled by the calling thread inside ``build`` go.
    """
    token = _on_the_way.set([])
    try:
        df = build()
        passed = list(_on_the_way.get() or [])
    finally:
        _on_the_way.reset(token)
    stored = settle(df, name)
    for path in passed:
        _delete(df.sparkSession, path)
    return stored


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete a settled table that has no readers left."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, file)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has settled; for when all results are read."""
    _delete(spark, folder(spark))
