"""The stored star: a full refresh writes it, reports open it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.model import Star
from salesmart.operators.audience import daily_audience, monthly_audience, named_sales, numbered_customers
from salesmart.operators.sales import daily_totals, sold_categories
from salesmart.sources.schemas import WAREHOUSE


TASK_BYTES = 4 << 20  # of the stored fact, for each task that adds up totals


def write_fact(fact: DataFrame, path: str) -> None:
    """Write the fact by month.

    REBALANCE groups rows by month and lets the adaptive planner split a month
    that is too big for one task and merge those that are small, so neither a hot
    month nor thousands of tiny files can arise. Inside a file the sales of a store
    lie together, so a manager's reports skip the pages of all other stores.
    """
    (
        fact.hint("rebalance", F.col("year"), F.col("month"))
        .sortWithinPartitions("year", "month", "store_id", "date")
        .write.mode("overwrite")
        .partitionBy("year", "month")
        .option("compression", "zstd")
        .parquet(path)
    )


def _by_store_month(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt by ranges of month and store, so that totals within a month and store need no further shuffle.

    A range is drawn from a sample: tasks are of like size and hold few months, so files are few. One
    store's month stays in one task; its sums take a row per group there, and spill if need be.
    """
    return rows.repartitionByRange(tasks, "year", "month", "store_id")


def _write_totals(totals: DataFrame, path: str, *by: str) -> None:
    """Write totals whose rows lie by store and month already."""
    totals.sortWithinPartitions(*by, "year", "month", "store_id", "date").write.mode("overwrite").partitionBy(
        *by, "year", "month"
    ).option("compression", "zstd").parquet(path)


def _published(spark: SparkSession, folder: str) -> tuple:
    """The file system, the folder of markers, and the numbers of the published versions."""
    markers = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/published")
    files = markers.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName()) for f in files.listStatus(markers)] if files.exists(markers) else []
    return files, markers, found


def write_star(star: Star, folder: str) -> int:
    """Full refresh into a new version, which is published when all of it is written.

    Beside the star it writes its daily totals, the categories sold and who bought, from the stored fact.
    Readers see the old version or the new one, never a mixture; a load that fails
    publishes nothing. The version's number is returned; ``drop_versions`` deletes old ones.
    """
    spark = star.fact.sparkSession
    files, markers, found = _published(spark, folder)
    version = max(found, default=0) + 1
    path = f"{folder}/version-{version}"

    def written(name: str) -> DataFrame:
        return spark.read.schema(WAREHOUSE[name]).parquet(f"{path}/{name}")

    for name in ("dim_date", "dim_store", "dim_product", "dim_customer"):
        getattr(star, name).write.mode("overwrite").parquet(f"{path}/{name}")
    write_fact(star.fact, f"{path}/fact")
    size = files.getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/fact")).getLength()
    tasks = max(1, -(-size // TASK_BYTES))
    sums = written("fact").select("date", "store_id", "product_id", "quantity", "revenue", "cost", "profit", "year", "month")
    _write_totals(daily_totals(_by_store_month(sums, tasks)), f"{path}/daily")
    sold_categories(written("daily"), written("dim_product")).write.mode("overwrite").parquet(f"{path}/sold")
    numbered_customers(written("dim_customer")).write.mode("overwrite").parquet(f"{path}/customer_numbers")
    numbers = spark.read.parquet(f"{path}/customer_numbers")
    audience = daily_audience(_by_store_month(named_sales(written("fact"), written("dim_product"), numbers), tasks))
    months = monthly_audience(audience).withColumn("grain", F.lit("monthly"))
    both = audience.withColumn("grain", F.lit("daily")).unionByName(months, allowMissingColumns=True)
    _write_totals(both, f"{path}/audience", "grain")  # in one query, so that both are made from one shuffle
    for grain in ("daily", "monthly"):
        made, place = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{p}") for p in (f"audience/grain={grain}", f"audience_{grain}"))
        files.delete(place, True)  # what a failed load left
        if not files.exists(made):  # no sales
            files.mkdirs(place)
        elif not files.rename(made, place):
            raise RuntimeError(f"can't put {made} in its place")
    spark.range(1).select(F.lit(star.unique_sales).alias("unique_sales")).write.mode("overwrite").parquet(f"{path}/load")
    files.mkdirs(markers)
    if not files.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(markers, str(version))):
        raise RuntimeError(f"version {version} of {folder} was published by another load meanwhile")
    return version


def open_star(spark: SparkSession, folder: str) -> Star:
    """The version published last."""
    found = _published(spark, folder)[2]
    if not found:
        raise FileNotFoundError(f"no star is published in {folder}")
    path = f"{folder}/version-{max(found)}"
    tables = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in WAREHOUSE.items()}
    return Star(**tables, unique_sales=spark.read.schema("unique_sales boolean").parquet(f"{path}/load").first()[0])


def drop_versions(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete all but the ``keep`` newest versions; for when nobody reads the older ones."""
    files, markers, found = _published(spark, folder)
    for version in sorted(found)[: max(0, len(found) - keep)]:
        path = spark._jvm.org.apache.hadoop.fs.Path
        files.delete(path(markers, str(version)), False)
        files.delete(path(f"{folder}/version-{version}"), True)
