"""File exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.functions.columns import money_text
from salesmart.sources import workbooks

REPORT_SHEET = "Sales Report"

NOTIFICATION_COLUMNS = [
    "notification_id", "user_id", "store_id", "type", "title", "message", "severity", "is_read", "created_at",
]


def _write(df: DataFrame, save: Callable[[DataFrame], None]) -> None:
    """Save in a single execution; an empty result is an error, raised when the files are written."""
    seen = Observation()
    save(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    if seen.get["rows"] == 0:
        raise ValueError("the export has no rows")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index column. An empty result is an error."""
    _write(df, lambda rows: rows.write.mode("overwrite").option("header", True).csv(path))


def write_workbooks(df: DataFrame, path: str, sheet: str = REPORT_SHEET) -> None:
    """Spreadsheet workbooks with a header, in the order of the rows. An empty result is an error."""
    workbooks.register(df.sparkSession)
    _write(df, lambda rows: rows.write.format(workbooks.FORMAT).mode("overwrite").option("sheet", sheet).save(path))


def report_lines(export: DataFrame, rows: int | None = None) -> DataFrame:
    """The printed report: one text line for each row of the export, or for its first ``rows``."""
    if rows is not None:
        export = export.orderBy(F.col("date").desc(), "sale_id").limit(rows)
    return export.select(
        "date",
        "sale_id",
        F.concat_ws(
            " | ",
            F.col("date").cast("string"),
            "store_name",
            "product_name",
            F.col("quantity").cast("string"),
            F.concat(F.lit("₪"), money_text(F.col("revenue"))),
        ).alias("line"),
    )


def write_report(export: DataFrame, path: str, rows: int | None = None) -> None:
    """The lines as text files whose names follow the order of the report."""
    lines = report_lines(export, rows).orderBy(F.col("date").desc(), "sale_id")
    _write(lines.select("line"), lambda text: text.write.mode("overwrite").text(path))


def numbered_alerts(alerts: DataFrame, now: Column) -> DataFrame:
    """Alerts with ``notification_id`` and ``created_at``.

    An alert's number is a hash of what it says, where, and of the day, with a count where
    several say the same: two runs that append side by side can't take one number for
    different alerts.
    """
    moment = now.cast("timestamp_ntz")
    said = ["type", "store_id", "title", "message"]
    nth = F.row_number().over(W.partitionBy(*said).orderBy("severity"))
    number = F.xxhash64(*said, moment.cast("date"), nth).bitwiseAND(F.lit(2**63 - 1))
    return alerts.withColumn("notification_id", number).withColumn("created_at", moment).select(*NOTIFICATION_COLUMNS)


def append_alerts(alerts: DataFrame, existing: DataFrame | None, path: str, now: Column) -> None:
    """Append alerts to the stored notifications; a second run of one day adds nothing that is there already."""
    numbered = numbered_alerts(alerts, now)
    if existing is not None:
        numbered = numbered.join(existing.select("notification_id"), "notification_id", "left_anti")
    numbered.select(*NOTIFICATION_COLUMNS).write.mode("append").parquet(path)
