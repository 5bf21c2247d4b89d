"""Demand, order quantities, suggestions and the alerts they raise."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.functions.columns import truncated
from salesmart.model import Scope, Star
from salesmart.operators.sales import (
    attach_to_page,
    restrict,
    select_sales,
    store_condition,
    trailing_days,
)
from salesmart.operators.upsert import upsert
from salesmart.sources.keyed import BUCKETS, KeyedTable
from salesmart.sources.schemas import INVENTORY_LEVELS


@dataclass(frozen=True)
class StockPolicy:
    """The defaults, the 10% buffer and the 80% minimum."""

    days: int = 60
    lead_time_days: int = 7
    holding_cost_rate: float = 0.2
    ordering_cost: float = 50.0
    buffer: float = 1.1
    minimum_share: float = 0.8


def _named(df: DataFrame, star: Star, *product_columns: str) -> DataFrame:
    """Inner joins to store and product, after all reduction is done."""
    stores = star.dim_store.select("store_id", "store_name")
    products = star.dim_product.select("product_id", "product_name", *product_columns)
    return df.join(stores, "store_id").join(products, "product_id")


def demand(
    star: Star, scope: Scope, as_of: date, days: int = 60, levels: DataFrame | None = None
) -> DataFrame:
    """Units and active days per store and product over the trailing days, with the
    stock columns of ``levels`` (zero where there is no row, or no table).

    Sales are first reduced to one row per store, product and date, which makes the
    count of days a plain count.
    """
    pair = ["store_id", "product_id"]
    sold = (
        select_sales(star, trailing_days(as_of, days), scope)
        .groupBy(*pair, "date")
        .agg(F.sum("quantity").alias("quantity"))
        .groupBy(*pair)
        .agg(F.sum("quantity").alias("total_qty"), F.count("*").alias("sales_days"))
    )
    if levels is None:
        zero = F.lit(0)
        sold = sold.select("*", zero.alias("current_stock"), zero.alias("stored_reorder"), zero.alias("stored_max"))
    else:
        stock = restrict(levels, store_condition(scope)).select(
            *pair,
            F.col("current_quantity").alias("current_stock"),
            F.col("reorder_point").alias("stored_reorder"),
            F.col("max_quantity").alias("stored_max"),
        )
        sold = sold.join(stock, pair, "left").fillna(0, ["current_stock", "stored_reorder", "stored_max"])
    return _named(sold, star, F.col("cost").alias("unit_cost"))


def _order_sizes(wanted: DataFrame, policy: StockPolicy) -> DataFrame:
    """Add daily demand, economic order quantity and the computed reorder point."""
    days = F.greatest(F.col("sales_days"), F.lit(1))
    daily = F.col("daily")
    holding = F.greatest(F.col("unit_cost").cast("double"), F.lit(1.0)) * policy.holding_cost_rate
    squared = 2 * (daily * 365) * policy.ordering_cost / F.greatest(holding, F.lit(1.0))
    return (
        wanted.where("sales_days > 0")
        .withColumn("daily", F.col("total_qty").cast("double") / days)
        .withColumn("eoq", truncated(F.greatest(F.lit(1.0), F.sqrt(squared))))
        .withColumn("computed_reorder", truncated(daily * policy.lead_time_days * policy.buffer))
    )


def optimise(wanted: DataFrame, policy: StockPolicy = StockPolicy()) -> DataFrame:
    """Order quantity, reorder point, minimum and maximum for each store and product."""
    reorder = F.col("computed_reorder")
    return _order_sizes(wanted, policy).select(
        "store_id",
        "store_name",
        "product_id",
        "product_name",
        "current_stock",
        F.bround("daily", 2).alias("daily_demand"),
        "eoq",
        reorder.alias("reorder_point"),
        F.greatest(F.lit(1), truncated(reorder * policy.minimum_share)).alias("min_level"),
        (reorder + F.col("eoq")).alias("max_level"),
    )


KEPT_KEYS = ["store_id", "product_id"]
THRESHOLDS = ["min_quantity", "max_quantity", "reorder_point"]


def _level_changes(optimised: DataFrame) -> DataFrame:
    return optimised.select(
        *KEPT_KEYS,
        F.col("current_stock").alias("current_quantity"),
        F.col("min_level").alias("min_quantity"),
        F.col("max_level").alias("max_quantity"),
        "reorder_point",
    )


def updated_levels(levels: DataFrame, optimised: DataFrame, now: Column) -> DataFrame:
    """Levels after an update: thresholds replaced, stock on hand kept, new pairs added."""
    return upsert(levels, _level_changes(optimised), KEPT_KEYS, THRESHOLDS, touched=("last_updated", now))


def stored_levels(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> KeyedTable:
    """The table of levels, dealt by store."""
    return KeyedTable(spark, folder, INVENTORY_LEVELS, tuple(KEPT_KEYS), ("store_id",), buckets)


def update_stored_levels(levels: KeyedTable, optimised: DataFrame, now: Column) -> int:
    """The same update of the stored table, which writes only the buckets of the stores it touches."""
    return levels.merge(_level_changes(optimised), THRESHOLDS, touched=("last_updated", now))


def reorder_suggestions(star: Star, scope: Scope, levels: DataFrame) -> DataFrame:
    """Pairs at or below their reorder point, with the quantity up to the maximum."""
    low = (
        restrict(levels, store_condition(scope))
        .where("current_quantity <= reorder_point")
        .select(
            "store_id",
            "product_id",
            F.col("current_quantity").alias("current_stock"),
            "reorder_point",
            F.greatest(F.lit(0), F.col("max_quantity") - F.col("current_quantity")).alias("suggested_order_qty"),
        )
    )
    return _named(low, star)


def auto_orders(wanted: DataFrame, policy: StockPolicy = StockPolicy()) -> DataFrame:
    """Orders from recent demand. A stored threshold above zero wins over the
    computed one; the quantity is at least the economic one."""
    reorder, stock = F.col("reorder_point"), F.col("current_stock")
    stored_reorder, stored_max = F.col("stored_reorder"), F.col("stored_max")
    return (
        _order_sizes(wanted, policy)
        .withColumn("reorder_point", F.when(stored_reorder > 0, stored_reorder).otherwise(F.col("computed_reorder")))
        .withColumn("max_level", F.when(stored_max > 0, stored_max).otherwise(reorder + F.col("eoq")))
        .where(stock <= reorder)
        .select(
            "store_id",
            "store_name",
            "product_id",
            "product_name",
            "current_stock",
            "reorder_point",
            "eoq",
            F.greatest(F.col("eoq"), F.col("max_level") - stock).alias("suggested_order_qty"),
        )
    )


def availability(
    star: Star, scope: Scope, levels: DataFrame, central: DataFrame | None = None
) -> DataFrame:
    """Store stock beside central stock; zero without a central row or table."""
    rows = restrict(levels, store_condition(scope)).select(
        "store_id", "product_id", F.col("current_quantity").alias("store_stock")
    )
    if central is None:
        rows = rows.withColumn("central_stock", F.lit(0))
    else:
        stock = central.select("product_id", F.col("current_stock").alias("central_stock"))
        rows = rows.join(stock, "product_id", "left").fillna(0, ["central_stock"])
    return _named(rows, star)


def list_levels(star: Star, scope: Scope, levels: DataFrame, rows: int | None = None) -> DataFrame:
    """Levels with names, the most recently updated first: all, or the first ``rows``."""
    newest = (F.col("last_updated").desc(), F.col("store_id"), F.col("product_id"))
    page = (
        restrict(levels, store_condition(scope))
        .select(
            "store_id", "product_id", "current_quantity", "min_quantity",
            "max_quantity", "reorder_point", "last_updated",
        )
    )
    if rows is not None:
        page = page.orderBy(*newest).limit(rows)
    page = attach_to_page(page, star.dim_store, "store_id", ["store_name"])
    page = attach_to_page(page, star.dim_product, "product_id", ["product_name"])
    return page.orderBy(*newest)


def _alerts(orders: DataFrame, kind: str, opening: str) -> DataFrame:
    """The texts of the alerts."""
    name, store = F.col("product_name"), F.col("store_name")
    quantity = F.col("suggested_order_qty").cast("string")
    return orders.select(
        F.lit(None).cast("bigint").alias("user_id"),
        "store_id",
        F.lit(kind).alias("type"),
        F.concat(F.lit("הזמנה אוטומטית - "), name).alias("title"),
        F.concat(
            F.lit(opening), quantity, F.lit(" יחידות עבור "), name, F.lit(" בסניף "), store, F.lit(".")
        ).alias("message"),
        F.lit("warning").alias("severity"),
        F.lit(False).alias("is_read"),
    )


def low_stock_alerts(suggestions: DataFrame) -> DataFrame:
    return _alerts(suggestions, "low_stock", "נוצרה הצעת הזמנה אוטומטית של ")


def auto_order_alerts(orders: DataFrame) -> DataFrame:
    return _alerts(orders, "auto_order", "הומלצה הזמנה אוטומטית של ")


def inventory_cards(optimised: DataFrame, suggestions: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: mean order quantity (half rounds up), pairs low on stock, units to order."""
    zero = F.lit(0).cast("bigint")
    parts = (
        optimised.agg(F.coalesce(F.floor(F.avg("eoq") + 0.5), zero).alias("avg_eoq"))
        .unionByName(suggestions.agg(F.count("*").alias("low_stock_count")), allowMissingColumns=True)
        .unionByName(
            orders.agg(F.coalesce(F.sum("suggested_order_qty"), zero).alias("total_auto_order_qty")),
            allowMissingColumns=True,
        )
    )
    return parts.agg(*(F.max(c).alias(c) for c in parts.columns))
