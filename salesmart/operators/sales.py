"""Selecting sales from the star, and bringing dimension columns to them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.model import SalesFilter, Scope, Star


def store_condition(scope: Scope, stores: tuple = (), column: str = "store_id") -> Column | None:
    """Which stores the caller may see; a manager's own store overrides the request.

    A manager without a store sees nothing.
    """
    if scope.is_admin:
        return F.col(column).isin(*stores) if stores else None
    return F.lit(False) if scope.store_id is None else F.col(column) == scope.store_id


def restrict(df: DataFrame, condition: Column | None) -> DataFrame:
    return df if condition is None else df.where(condition)


def bounds(flt: SalesFilter) -> tuple[Column, Column]:
    """First and last day of the range."""
    return F.lit(flt.date_start), F.current_date() if flt.date_end is None else F.lit(flt.date_end)


def date_condition(flt: SalesFilter) -> Column | None:
    """The date range, and the same range on the partition columns to prune by."""
    if flt.all_dates:
        return None
    start, end = bounds(flt)

    def months(year: Column, month: Column) -> Column:
        return year * 12 + month

    partition = months(F.col("year"), F.col("month"))
    years = F.col("year").between(F.year(start), F.year(end))  # plain bounds, which a catalog can prune by
    return F.col("date").between(start, end) & years & partition.between(
        months(F.year(start), F.month(start)), months(F.year(end), F.month(end))
    )


def trailing_days(as_of: date, days: int) -> SalesFilter:
    """Everything from ``days`` days before ``as_of`` on, open at the end."""
    return SalesFilter(as_of - timedelta(days=days), date.max)


def daily_totals(fact: DataFrame) -> DataFrame:
    """Sums per date, store and product; ``sales`` counts rows, ``priced`` those with a revenue."""
    measures = [F.sum(m).alias(m) for m in ("quantity", "revenue", "cost", "profit")]
    return fact.groupBy("date", "store_id", "product_id", "year", "month").agg(
        *measures, F.count("*").alias("sales"), F.count("revenue").alias("priced")
    )


def sold_categories(daily: DataFrame, dim_product: DataFrame) -> DataFrame:
    """The categories that each store has sold; a shuffle carries a row per task, store and category where products are broadcast."""
    categories = dim_product.select("product_id", "category")
    return daily.select("store_id", "product_id").join(categories, "product_id").select("store_id", "category").distinct()


def select_totals(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    """Rows to add up: the daily totals that pass the filter, or the sales where the star has no totals.

    Sums over ``sales`` and ``priced`` take the place of row counts. Where ids may repeat, the
    sales themselves are needed.
    """
    if star.daily is not None and star.unique_sales:
        return _selected(star.daily, star, flt, scope)
    return select_sales(star, flt, scope).withColumns({"sales": F.lit(1), "priced": F.col("revenue").isNotNull().cast("int")})


def sale_count(star: Star) -> Column:
    """Distinct sales among rows of ``select_totals``."""
    return F.coalesce(F.sum("sales"), F.lit(0)) if star.unique_sales else F.count_distinct("sale_id")


def select_sales(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    """Fact rows that pass the filter."""
    return _selected(star.fact, star, flt, scope)


def _selected(rows: DataFrame, star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    """Rows that pass the filter.

    Dates and stores are conditions on the fact's own columns and reach the Parquet
    scan. Regions and categories are semi joins with the filtered dimension, and
    only those asked for: every key exists in its dimension, so a join that neither
    filters nor adds columns can be left out.
    """
    sales = restrict(rows, date_condition(flt))
    sales = restrict(sales, store_condition(scope, flt.stores))
    if flt.regions:
        keys = star.dim_store.where(F.col("region").isin(*flt.regions)).select("store_id")
        sales = sales.join(keys, "store_id", "left_semi")
    if flt.categories:
        keys = star.dim_product.where(F.col("category").isin(*flt.categories)).select("product_id")
        sales = sales.join(keys, "product_id", "left_semi")
    return sales


def transactions(star: Star) -> Column:
    """Distinct sales. Where the id is known to be unique, and never null, that is the
    number of rows, and the id column need not be read at all."""
    return F.count("*") if star.unique_sales else F.count_distinct("sale_id")


DIMENSIONS = {
    "date": ("dim_date", ["date_id"]),
    "store": ("dim_store", ["store_id"]),
    "product": ("dim_product", ["product_id"]),
    "customer": ("dim_customer", ["customer_id"]),
}


def star_rows(
    star: Star, flt: SalesFilter, scope: Scope, dims: tuple = ("date", "store", "product")
) -> DataFrame:
    """Sale rows with the columns of the named dimensions.

    Columns that several dimensions share get the dimension's name in front
    (``customer_city``, ``product_cost``). The size of each dimension decides, at
    run time, between broadcasting it and a sort-merge join with skew splitting.
    """
    rows = select_sales(star, flt, scope).drop("date", "year", "month")
    for name in dims:
        table, key = DIMENSIONS[name]
        dimension = getattr(star, table)
        shared = [c for c in dimension.columns if c in rows.columns and c not in key]
        dimension = dimension.withColumnsRenamed({c: f"{name}_{c}" for c in shared})
        rows = rows.join(dimension, key)
    return rows


def attach_to_page(page: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Bring dimension columns to a page.

    A row limit tells the planner how large the page can be: it broadcasts a short one and
    sort-merges a long one. The dimension's keys are unique, so the result is no longer
    than the page.
    """
    return dimension.select(key, *columns).join(page, key)
