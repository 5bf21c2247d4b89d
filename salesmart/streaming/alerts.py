"""Alerts from streams of stock levels or orders, written once however often a batch is run."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.model import Scope, Star
from salesmart.plans.inventory import auto_order_alerts, low_stock_alerts, reorder_suggestions
from salesmart.sources.sinks import NOTIFICATION_COLUMNS, numbered_alerts
from salesmart.streaming.runs import Progress, run_to_end

ALERTS = (
    "notification_id bigint, user_id bigint, store_id bigint, type string, title string, message string, "
    "severity string, is_read boolean, created_at timestamp_ntz, day date, source string, batch bigint"
)


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """All alerts that streams have written to ``folder``."""
    return spark.read.schema(ALERTS).option("basePath", folder).parquet(folder).select(*NOTIFICATION_COLUMNS)


def batch_writer(folder: str, source: str, alerts_of: Callable[[DataFrame], DataFrame], now: datetime) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: one folder per day, stream and batch.

    A batch that runs again replaces its own folder with the same alerts. An alert that another
    batch of the day has written, known by its number, is not written again; so even a stream that
    begins anew with another division into batches adds nothing. Only the day's alerts are read.
    ``source`` names the stream; streams of different names may write side by side.
    """
    day = f"{folder}/day={now.date().isoformat()}"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{day}/source={source}/batch={number}"
        alerts = numbered_alerts(alerts_of(batch), F.lit(now))
        path = spark._jvm.org.apache.hadoop.fs.Path(day)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.schema(ALERTS).option("basePath", folder).parquet(day)
            others = known.where((F.col("source") != source) | (F.col("batch") != number))
            alerts = alerts.join(others.select("notification_id"), "notification_id", "left_anti")
        alerts.select(*NOTIFICATION_COLUMNS).write.mode("overwrite").parquet(own)

    return write


def watch_levels(levels: DataFrame, star: Star, scope: Scope, folder: str, checkpoint: str, now: datetime) -> Progress:
    """Low-stock alerts for a stream of stock levels at or below their reorder point.

    Of several levels of one store and product in a batch the one updated last counts.
    """
    newest = W.partitionBy("store_id", "product_id").orderBy(F.col("last_updated").desc_nulls_last(), "current_quantity", "reorder_point", "max_quantity")

    def low(batch: DataFrame) -> DataFrame:
        last = batch.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")
        return low_stock_alerts(reorder_suggestions(star, scope, last))

    return run_to_end(levels.writeStream.foreachBatch(batch_writer(folder, "levels", low, now)), checkpoint)


def watch_orders(orders: DataFrame, folder: str, checkpoint: str, now: datetime) -> Progress:
    """An alert for each order of a stream of automatic orders."""
    return run_to_end(orders.writeStream.foreachBatch(batch_writer(folder, "orders", auto_order_alerts, now)), checkpoint)
