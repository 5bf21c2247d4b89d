"""Days whose revenue is far from the average day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.functions.columns import percent

LEAST_DAYS = 7
SIGMAS = 2


def flag_days(daily: DataFrame) -> DataFrame:
    """Days beyond two sample standard deviations; none from fewer than seven days.

    The unpartitioned window sees one row per day, never sale rows.
    """
    everything = W.partitionBy()
    revenue = F.col("revenue")
    mean = F.col("expected_revenue")
    judged = daily.select("date", F.col("daily_revenue").cast("double").alias("revenue")).select(
        "date",
        "revenue",
        F.avg("revenue").over(everything).alias("expected_revenue"),
        F.stddev_samp("revenue").over(everything).alias("_std"),
        F.count("*").over(everything).alias("_days"),
    )
    return (
        judged.where((F.col("_days") >= LEAST_DAYS) & (F.abs(revenue - mean) > SIGMAS * F.col("_std")))
        .select(
            F.date_format("date", "yyyy-MM-dd").alias("date"),
            "revenue",
            "expected_revenue",
            percent(revenue - mean, mean).alias("deviation"),
            F.when(revenue > mean, "high").otherwise("low").alias("type"),
        )
        .orderBy("date")
    )


def daily_statistics(daily: DataFrame) -> DataFrame:
    """One row: mean, sample deviation and number of days; none below seven days."""
    revenue = F.col("daily_revenue").cast("double")
    return daily.agg(
        F.avg(revenue).alias("mean_revenue"),
        F.stddev_samp(revenue).alias("std_revenue"),
        F.count("*").alias("total_days"),
    ).where(F.col("total_days") >= LEAST_DAYS)
