"""Time the load job and the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of test tables, BENCH_CPUS the cores, BENCH_RUNS how
often each query is run; the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from salesmart.checks import retail_tables  # noqa: E402
from salesmart.checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "kpis", "sales_trend", "store_performance", "product_performance", "category_revenue",
    "customer_insights", "seasonal_quarterly", "seasonal_monthly", "daily_sales", "anomaly_daily",
    "filter_combined", "export_sales", "filter_options_store", "demand_with_stock",
    "inventory_optimization", "auto_orders", "inventory_availability", "customer_features",
    "customer_segments", "forecast_full", "forecast_linear_by_store", "forecast_arima_by_store",
    "notification_feed_store", "dq_iqr_outliers", "etl_clean_sales", "dq_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("salesmart-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    times = {}
    for name, step in (("write_extract_cold", retail_tables.raw_tables), ("etl_load_cold", retail_tables.stored)):
        begun = time.perf_counter()
        step(spark, sf_dir)
        times[name] = round(time.perf_counter() - begun, 3)
    for name in HEADLINE:
        run(name)
        times[name] = round(median(run(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "cold extract and ETL load plus the sum of warm median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
