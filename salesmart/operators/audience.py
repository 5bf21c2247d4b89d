"""Who bought, as bits: distinct customers of any filter without their sales.

The load numbers customers so that those of one age group and gender lie together. 64 neighbours
make a word, and the bits of ``members`` tell which of them bought on a day or in a month, in a store
and category. Words merge by OR, so counts are exact for any filter, and a shuffle carries one row
per word instead of one per customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.model import SalesFilter, Scope, Star
from salesmart.operators.sales import bounds, date_condition, restrict, store_condition

COHORT = ["age_group", "gender"]
WORD = 64
BROADCAST_ROWS = 1_500_000


def numbered_customers(dim_customer: DataFrame) -> DataFrame:
    """``customer_id``, its cohort, ``word`` and ``bit``.

    Numbers follow a range sort by cohort: dense in each task, apart between tasks. They differ from
    run to run, so the load stores them before it uses them.
    """
    by = [*COHORT, "customer_id"]
    dealt = dim_customer.select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    return dealt.withColumn("number", F.monotonically_increasing_id()).selectExpr(
        *by, f"number div {WORD} as word", f"shiftleft(1L, cast(number % {WORD} as int)) as bit"
    )


def named_sales(fact: DataFrame, dim_product: DataFrame, customers: DataFrame) -> DataFrame:
    """What the audience is made of: sales with their category and the customer's word and bit.

    Names of up to ``BROADCAST_ROWS`` products or customers are sent to every executor; more are sort-merged, however
    small their files are.
    """
    sales = fact.select("date", "store_id", "product_id", "customer_id", "revenue", "year", "month")
    for names, key in ((dim_product.select("product_id", "category"), "product_id"), (customers, "customer_id")):
        sales = sales.join(F.broadcast(names) if names.count() <= BROADCAST_ROWS else names.hint("merge"), key)
    return sales.select("date", "store_id", "category", *COHORT, "word", "bit", "revenue", "year", "month")


def daily_audience(named: DataFrame) -> DataFrame:
    """Members, revenue and priced sales per date, store, category and word."""
    return named.groupBy("date", "store_id", "category", *COHORT, "word", "year", "month").agg(
        F.bit_or("bit").alias("members"), F.sum("revenue").alias("revenue"), F.count("revenue").alias("priced")
    )


def monthly_audience(daily: DataFrame) -> DataFrame:
    """The same per month."""
    return daily.groupBy("store_id", "category", *COHORT, "word", "year", "month").agg(
        F.bit_or("members").alias("members"), F.sum("revenue").alias("revenue"), F.sum("priced").alias("priced")
    )


def select_audience(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    """Words that pass the filter: whole months by month, the days before and after them by day."""
    columns = ["store_id", "category", *COHORT, "word", "members", "revenue", "priced"]
    rows = star.audience_monthly
    if flt.all_dates:
        rows = rows.select(*columns)
    else:
        start, end = bounds(flt)
        first = F.make_date("year", "month", F.lit(1))
        whole = (first >= start) & (F.last_day(first) <= end)
        edges = star.audience_daily.where(date_condition(flt) & ~whole)
        rows = rows.where(whole).select(*columns).unionByName(edges.select(*columns))
    rows = restrict(rows, store_condition(scope, flt.stores))
    if flt.regions:
        keys = star.dim_store.where(F.col("region").isin(*flt.regions)).select("store_id")
        rows = rows.join(keys, "store_id", "left_semi")
    return rows.where(F.col("category").isin(*flt.categories)) if flt.categories else rows


def audience_by_word(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    """One row per cohort and word: how many customers bought, their revenue and priced sales."""
    merged = select_audience(star, flt, scope).groupBy(*COHORT, "word").agg(
        F.bit_or("members").alias("members"), F.sum("revenue").alias("revenue"), F.sum("priced").alias("sales")
    )
    return merged.withColumn("customers", F.bit_count("members"))
