"""From raw tables to the stored star."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.functions.columns import quarter_name
from salesmart.model import RawTables, Star
from salesmart.operators.quality import clean, keep_valid_references
from salesmart.sources.schemas import FACT_COLUMNS
from salesmart.sources.shared import discard, settle
from salesmart.sources.warehouse import open_star, write_star


def date_dimension(dates: DataFrame) -> DataFrame:
    """One row per observed date, keyed 1..n in date order.

    The numbering runs in one task, over distinct dates only: a few thousand rows
    for any amount of sales.
    """
    day = F.col("date")
    return dates.select("date").distinct().select(
        F.row_number().over(W.orderBy("date")).alias("date_id"),
        "date",
        F.dayofmonth(day).alias("day"),
        F.month(day).alias("month"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        F.date_format(day, "MMMM").alias("month_name"),
        quarter_name(F.quarter(day)).alias("quarter_name"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        (F.weekday(day) >= 5).alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
    )


def customer_dimension(customers: DataFrame) -> DataFrame:
    """Without the e-mail address."""
    return customers.select("customer_id", "customer_name", "gender", "age", "age_group", "city")


def dated(sales: DataFrame) -> DataFrame:
    """The calendar date of a sale in place of its timestamp."""
    return sales.withColumn("date", F.to_date("sale_date")).drop("sale_date")


def with_date_key(sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Map dates to keys. The date dimension is broadcast: the calendar bounds it."""
    return sales.join(F.broadcast(dim_date.select("date", "date_id", "year", "month")), "date")


def keyed(cleaned: RawTables) -> Star:
    """Cleaned tables as a star whose fact still holds unknown references.

    The date dimension covers all clean sales, so every date must be known before
    the first sale can get its key. The clean sales are therefore stored once and
    read twice, which costs far less than deduplicating twice. A sale without an id
    has no primary key and cannot be a fact; ``quality.missing_ids`` counts them.
    """
    return _keyed(cleaned, settle(dated(cleaned.sales), "clean_sales"))


def _keyed(cleaned: RawTables, sales: DataFrame) -> Star:
    dim_date = date_dimension(sales)
    fact = with_date_key(sales.where("sale_id is not null"), dim_date).select(*FACT_COLUMNS, "date", "year", "month")
    return Star(fact, dim_date, cleaned.stores, cleaned.products, customer_dimension(cleaned.customers))


def conform(cleaned: RawTables, unique_sales: bool = False) -> Star:
    """The star without the sales whose store, product or customer is unknown.

    The date needs no check: its key was taken from the dimension. ``unique_sales`` says
    that the caller has removed repeated sales, as ``clean`` does.
    """
    return _conformed(keyed(cleaned), unique_sales)


def _conformed(star: Star, unique_sales: bool) -> Star:
    fact = keep_valid_references(star.fact, star, ("store", "product", "customer"))
    return replace(star, fact=fact, unique_sales=unique_sales)


def run_etl(raw: RawTables, folder: str, sales_order: Sequence[str] | None = None, reread: bool = False) -> Star:
    """Clean, conform and store; return the stored star. The copy of the clean sales goes afterwards."""
    cleaned = clean(raw, sales_order, reread)
    sales = settle(dated(cleaned.sales), "clean_sales")
    write_star(_conformed(_keyed(cleaned, sales), unique_sales=True), folder)
    discard(sales)
    return open_star(raw.sales.sparkSession, folder)
