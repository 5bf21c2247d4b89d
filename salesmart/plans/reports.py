"""The dashboard reports.

Each one reduces the fact by a key first and only then fetches names from the
dimension with that key. The shuffle carries one partial row per key and task, so
a store or product that holds a third of all sales is no heavier than any other,
and a large dimension meets totals instead of sale rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.functions.columns import (
    month_name,
    percent,
    quarter_name,
    quarter_of,
    ratio,
    shekels,
)
from salesmart.model import ADMIN, SalesFilter, Scope, Star
from salesmart.operators.audience import audience_by_word
from salesmart.operators.sales import (
    attach_to_page,
    restrict,
    sale_count,
    select_sales,
    select_totals,
    store_condition,
)

TOP_STORES = 15
TOP_PRODUCTS = 20
CHART_PRODUCTS = 10


def _total(column: str) -> Column:
    return F.sum(column).alias(column)


def _margin() -> Column:
    return percent(F.sum("profit"), F.sum("revenue"))


def _average() -> Column:
    return ratio(F.sum("revenue"), F.sum("priced"))


def kpis(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    """One row of totals; no row when nothing was sold."""
    return (
        select_totals(star, flt, scope)
        .agg(
            sale_count(star).alias("total_transactions"),
            F.sum("revenue").alias("total_revenue"),
            F.sum("profit").alias("total_profit"),
            _margin().alias("profit_margin"),
            _average().alias("avg_order_value"),
            F.sum("quantity").alias("total_quantity"),
        )
        .where(F.col("total_revenue").isNotNull())
    )


def sales_trend(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    return (
        select_totals(star, flt, scope)
        .groupBy("year", "month")
        .agg(_total("revenue"), _total("profit"), sale_count(star).alias("transactions"))
        .withColumn("month_name", month_name(F.col("month")))
        .orderBy("year", "month")
    )


def store_performance(star: Star, flt: SalesFilter, scope: Scope, top: int = TOP_STORES) -> DataFrame:
    page = (
        select_totals(star, flt, scope)
        .groupBy("store_id")
        .agg(
            _total("revenue"),
            _total("profit"),
            _margin().alias("profit_margin"),
            sale_count(star).alias("transactions"),
        )
        .orderBy(F.col("revenue").desc(), "store_id")
        .limit(top)
    )
    named = attach_to_page(page, star.dim_store, "store_id", ["store_name", "city", "region"])
    return named.orderBy(F.col("revenue").desc(), "store_id")


def product_performance(
    star: Star, flt: SalesFilter, scope: Scope, top: int = TOP_PRODUCTS
) -> DataFrame:
    page = (
        select_totals(star, flt, scope)
        .groupBy("product_id")
        .agg(
            F.sum("quantity").alias("total_quantity"),
            _total("revenue"),
            _total("profit"),
            sale_count(star).alias("sales_count"),
        )
        .orderBy(F.col("revenue").desc(), "product_id")
        .limit(top)
    )
    named = attach_to_page(page, star.dim_product, "product_id", ["category", "brand", "product_name"])
    return named.orderBy(F.col("revenue").desc(), "product_id").drop("product_id")


def top_products(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    """The first ten of the product report, for the chart."""
    return product_performance(star, flt, scope, CHART_PRODUCTS).select("product_name", "revenue")


def category_revenue(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    by_product = (
        select_totals(star, flt, scope)
        .groupBy("product_id")
        .agg(_total("revenue"), _total("profit"), _total("quantity"))
    )
    return (
        by_product.join(star.dim_product.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(_total("revenue"), _total("profit"), _total("quantity"))
        .orderBy(F.col("revenue").desc(), "category")
    )


def customer_insights(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    """Revenue by age group and gender.

    After the first step there is one row per customer, or one per 64 of them where the load has
    kept who bought, so counting customers needs no distinct. ``avg_revenue_per_customer`` is the
    average per sale; the name is the report's.
    """
    if star.audience_daily is not None:
        rows = audience_by_word(star, flt, scope)
    else:
        by_customer = (
            select_sales(star, flt, scope)
            .groupBy("customer_id")
            .agg(_total("revenue"), F.count("revenue").alias("sales"), F.lit(1).alias("customers"))
        )
        rows = by_customer.join(star.dim_customer.select("customer_id", "age_group", "gender"), "customer_id")
    return (
        rows.groupBy("age_group", "gender")
        .agg(
            F.sum("customers").alias("customer_count"),
            _total("revenue"),
            ratio(F.sum("revenue"), F.sum("sales")).alias("avg_revenue_per_customer"),
        )
        .orderBy("age_group", "gender")
    )


def customer_grouping_sets(insights: DataFrame) -> DataFrame:
    """Revenue by age group alone and by gender alone, from the report above."""
    return insights.groupingSets([["age_group"], ["gender"]], "age_group", "gender").agg(
        _total("revenue")
    )


def share_of_total(report: DataFrame, label: str) -> DataFrame:
    """Each label's share of revenue in percent. Runs over report rows, not sales."""
    by_label = report.groupBy(label).agg(_total("revenue"))
    whole = F.sum("revenue").over(W.partitionBy())
    return by_label.select(label, "revenue", percent(F.col("revenue"), whole).alias("share_pct"))


def top_store(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    return store_performance(star, flt, scope, 1).select("store_name", "revenue", "profit")


def top_category(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    return category_revenue(star, flt, scope).select("category", "revenue").limit(1)


def insight_cards(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    """Up to two cards: title, description, metric.

    Fixed values: the texts of the cards.
    """
    store = top_store(star, flt, scope).select(
        F.lit("🏆 סניף מוביל").alias("title"),
        F.concat(
            F.lit("הסניף המוביל הוא "), "store_name", F.lit(" עם הכנסות של "), shekels(F.col("revenue"))
        ).alias("description"),
        F.concat(F.lit("רווח: "), shekels(F.col("profit"))).alias("metric"),
    )
    category = top_category(star, flt, scope).select(
        F.lit("📦 קטגוריה מובילה").alias("title"),
        F.concat(F.lit("הקטגוריה המובילה היא "), "category").alias("description"),
        F.concat(F.lit("הכנסות: "), shekels(F.col("revenue"))).alias("metric"),
    )
    return store.unionByName(category)


def daily_sales(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    return (
        select_totals(star, flt, scope)
        .groupBy("date")
        .agg(
            F.sum("revenue").alias("daily_revenue"),
            F.sum("quantity").alias("daily_quantity"),
            sale_count(star).alias("daily_transactions"),
        )
        .orderBy("date")
    )


def export_sales(star: Star, flt: SalesFilter, scope: Scope, rows: int | None = None) -> DataFrame:
    """Sale rows with their names, newest first, ``sale_id`` added to make the order total.

    All of them, unless a number of ``rows`` is asked for; then the newest are found on the
    fact alone, and only they meet the dimensions.
    """
    limit = rows
    rows = select_sales(star, flt, scope).select(
        "sale_id", "date", "store_id", "product_id", "customer_id", "quantity", "revenue", "profit"
    )
    if limit is not None:
        rows = rows.orderBy(F.col("date").desc(), "sale_id").limit(limit)
    for dimension, key, columns in (
        (star.dim_store, "store_id", ["store_name", "city", "region"]),
        (star.dim_product, "product_id", ["product_name", "category"]),
        (star.dim_customer, "customer_id", ["customer_name", "age_group"]),
    ):
        rows = attach_to_page(rows, dimension, key, columns)
    return rows.orderBy(F.col("date").desc(), "sale_id").select(
        "sale_id", "date", "store_name", "city", "region", "product_name", "category",
        "customer_name", "age_group", "quantity", "revenue", "profit",
    )


def _everything(star: Star) -> DataFrame:
    """What the views add up: all totals."""
    return select_totals(star, SalesFilter(all_dates=True), ADMIN)


def monthly_summary(star: Star) -> DataFrame:
    """The monthly view: all sales, no filter; who reads a view sorts it."""
    return (
        _everything(star).groupBy("year", "month")
        .agg(
            F.sum("sales").alias("total_transactions"),
            F.sum("quantity").alias("total_quantity"),
            F.sum("revenue").alias("total_revenue"),
            F.sum("cost").alias("total_cost"),
            F.sum("profit").alias("total_profit"),
            _average().alias("avg_revenue_per_transaction"),
            _margin().alias("profit_margin_pct"),
        )
        .withColumn("quarter", quarter_of(F.col("month")))
        .withColumn("month_name", month_name(F.col("month")))
    )


def store_summary(star: Star) -> DataFrame:
    by_store = _everything(star).groupBy("store_id").agg(
        F.sum("sales").alias("total_transactions"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("profit").alias("total_profit"),
        _margin().alias("profit_margin_pct"),
        _average().alias("avg_order_value"),
    )
    names = star.dim_store.select("store_id", "store_name", "city", "region", "store_type")
    return by_store.join(names, "store_id")


def product_summary(star: Star) -> DataFrame:
    by_product = _everything(star).groupBy("product_id").agg(
        F.sum("sales").alias("total_sales"),
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("profit").alias("total_profit"),
        _average().alias("avg_revenue_per_sale"),
    )
    names = star.dim_product.select("product_id", "product_name", "category", "brand")
    return by_product.join(names, "product_id")


def install_views(star: Star) -> None:
    """Register the tables and the three summary views for SQL."""
    views = {
        "fact_sales": star.fact,
        "dim_date": star.dim_date,
        "dim_store": star.dim_store,
        "dim_product": star.dim_product,
        "dim_customer": star.dim_customer,
        "v_monthly_sales": monthly_summary(star),
        "v_store_performance": store_summary(star),
        "v_product_performance": product_summary(star),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def filter_options(star: Star, scope: Scope) -> dict[str, DataFrame]:
    """What the filter form offers: stores, categories, regions, each in order."""
    order = {"stores": ("store_name", "store_id"), "categories": ("category",), "regions": ("region",)}
    return {name: options.orderBy(*order[name]) for name, options in _options(star, scope).items()}


def _options(star: Star, scope: Scope) -> dict[str, DataFrame]:
    """A manager gets the own store and region, and the categories actually sold there."""
    own = store_condition(scope)
    stores = restrict(star.dim_store, own)
    if scope.is_admin:
        products = star.dim_product
    elif star.sold is not None:
        products = restrict(star.sold, own)
    else:
        sold = restrict(star.fact, own).select("product_id").distinct()
        products = star.dim_product.join(sold, "product_id", "left_semi")
    return {
        "stores": stores.select("store_id", "store_name", "city").distinct(),
        "categories": products.select("category").distinct(),
        "regions": stores.select("region").distinct(),
    }


def filter_option_rows(star: Star, scope: Scope) -> DataFrame:
    """The same options in one table: kind, id, label, city; in order of kind and label."""
    options = _options(star, scope)
    none = F.lit(None)
    return reduce(
        DataFrame.unionByName,
        (
            options["stores"].select(
                F.lit("store").alias("kind"), F.col("store_id").alias("id"), F.col("store_name").alias("label"), "city"
            ),
            options["categories"].select(
                F.lit("category").alias("kind"),
                none.cast("bigint").alias("id"),
                F.col("category").alias("label"),
                none.cast("string").alias("city"),
            ),
            options["regions"].select(
                F.lit("region").alias("kind"),
                none.cast("bigint").alias("id"),
                F.col("region").alias("label"),
                none.cast("string").alias("city"),
            ),
        ),
    ).orderBy("kind", "label", "id")


def quarterly_sales(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    quarter = quarter_of(F.col("month"))
    return (
        select_totals(star, flt, scope)
        .groupBy("year", quarter.alias("quarter"))
        .agg(
            _total("revenue"),
            _total("profit"),
            sale_count(star).alias("transactions"),
            _average().alias("avg_revenue"),
        )
        .withColumn("quarter_name", quarter_name(F.col("quarter")))
        .orderBy("year", "quarter")
    )


def monthly_pattern(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    """Month-of-year averages of the monthly totals."""
    totals = (
        select_totals(star, flt, scope).groupBy("year", "month").agg(_total("revenue"), _total("profit"))
    )
    return (
        totals.groupBy("month")
        .agg(
            ratio(F.sum("revenue"), F.count("revenue")).alias("avg_revenue"),
            ratio(F.sum("profit"), F.count("profit")).alias("avg_profit"),
            F.count("*").alias("year_count"),
        )
        .withColumn("month_name", month_name(F.col("month")))
        .orderBy("month")
    )


def seasonal_insights(pattern: DataFrame) -> DataFrame:
    """Peak and low month against the mean of the monthly averages; of equal months
    the earliest. At most twelve rows go through the unpartitioned windows."""
    ranked = pattern.select(
        "month",
        "month_name",
        "avg_revenue",
        F.avg("avg_revenue").over(W.partitionBy()).alias("mean"),
        F.row_number().over(W.orderBy(F.col("avg_revenue").desc(), "month")).alias("from_top"),
        F.row_number().over(W.orderBy("avg_revenue", "month")).alias("from_bottom"),
    )
    part = ratio(F.col("avg_revenue"), F.col("mean"))

    def insight(position: str, kind: str, difference: Column) -> DataFrame:
        return ranked.where(F.col(position) == 1).select(
            F.lit(kind).alias("type"),
            F.col("month_name").alias("month"),
            F.col("avg_revenue").alias("revenue"),
            (difference * 100).alias("percentage"),
        )

    peak = insight("from_top", "peak_month", part - 1)
    return peak.unionByName(insight("from_bottom", "low_month", 1 - part))
