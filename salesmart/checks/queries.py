"""The registered queries: name to (spark, sf_dir) -> DataFrame.

Amounts leave the library as decimals; here they become doubles. Sums of decimals
are exact, so their quotients agree to the last bit and stay as they are; only
statistics whose last digits depend on the order of summation are rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.checks import retail_tables as t
from salesmart.functions import columns as c
from salesmart.model import ADMIN, RawTables, SalesFilter, Scope
from salesmart.operators import quality
from salesmart.operators.dedupe import keep_first
from salesmart.operators.sales import star_rows, trailing_days
from salesmart.plans import anomaly, forecast, inventory, notifications, reports, segments
from salesmart.plans.etl import conform
from salesmart.sources import sinks, workbooks
from salesmart.sources.schemas import FACT_COLUMNS, INVENTORY_LEVELS
from salesmart.sources.shared import settle, shared_folder
from salesmart.sources.tables import optional_table, read_raw, run_query
from salesmart.streaming import alerts as stream_alerts_job
from salesmart.streaming import daily as stream_daily
from salesmart.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PERIOD = SalesFilter(date(1996, 1, 1), date(1997, 12, 31))
EVER = SalesFilter(all_dates=True)
MANAGER = Scope("store_manager", store_id=3, user_id=8)
ADMIN_8 = Scope("admin", user_id=8)


def plain(df: DataFrame, **digits: int) -> DataFrame:
    """Decimals as doubles; the named double columns rounded."""
    kinds = dict(df.dtypes)
    return df.select(
        *(
            F.round(F.col(n), digits[n]).alias(n)
            if n in digits
            else F.col(n).cast("double").alias(n)
            if kinds[n].startswith("decimal")
            else F.col(n)
            for n in df.columns
        )
    )


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def report(name: str, build: Callable, flt: SalesFilter = PERIOD, scope: Scope = ADMIN, **digits: int) -> None:
    """Register a report that takes (star, filter, scope)."""
    QUERIES[name] = lambda spark, sf_dir: plain(build(t.stored(spark, sf_dir).star, flt, scope), **digits)


# ---- scans and sinks


@query
def raw_sales_scan(spark, sf_dir):
    return plain(t.sales(spark, sf_dir).withColumn("sale_date", F.to_date("sale_date")))


@query
def warehouse_roundtrip(spark, sf_dir):
    return plain(t.stored(spark, sf_dir).star.fact)


def _export(spark, sf_dir):
    return reports.export_sales(t.stored(spark, sf_dir).star, PERIOD, ADMIN)


@query
def export_sales(spark, sf_dir):
    return plain(_export(spark, sf_dir))


@query
def export_csv_roundtrip(spark, sf_dir):
    rows = _export(spark, sf_dir)
    path = f"{shared_folder(spark)}/export-{uuid4().hex}"
    sinks.write_csv(rows, path)
    return plain(spark.read.schema(rows.schema).option("header", True).csv(path))


@query
def export_workbook_roundtrip(spark, sf_dir):
    """The whole export as spreadsheets, read back."""
    rows = _export(spark, sf_dir)
    path = f"{shared_folder(spark)}/workbooks-{uuid4().hex}"
    sinks.write_workbooks(rows, path)
    return plain(spark.read.format(workbooks.FORMAT).schema(rows.schema).load(path))


def _extract_of_workbooks(spark, sf_dir, *tables):
    """The named tables as spreadsheets, sales in as many files as tasks run side by side, and read as an extract."""
    folder = f"{shared_folder(spark)}/extract-{uuid4().hex}"
    for name, _, table in t.raw_tables(spark, sf_dir).items():
        if name in tables:
            dealt = table.repartition(spark.sparkContext.defaultParallelism) if name == "sales" else table
            sinks.write_workbooks(dealt, f"{folder}/{name}", sheet=name)
    return read_raw(spark, folder, workbooks.FORMAT)


@query
def workbook_customers(spark, sf_dir):
    return _extract_of_workbooks(spark, sf_dir, "customers").customers


@query
def workbook_sales_scan(spark, sf_dir):
    """Sales from spreadsheets, with their dates as the text that the cleaning step takes."""
    return plain(_extract_of_workbooks(spark, sf_dir, "sales").sales.withColumn("sale_date", F.to_date("sale_date")))


@query
def workbook_fact_sales(spark, sf_dir):
    """An extract of spreadsheets through the whole load."""
    cleaned = quality.clean(_extract_of_workbooks(spark, sf_dir, *(name for name, _ in RawTables.KEYS)), t.SALES_ORDER)
    return plain(conform(cleaned, unique_sales=True).fact.select(*FACT_COLUMNS))


@query
def report_lines(spark, sf_dir):
    return sinks.report_lines(_export(spark, sf_dir)).select("line")


# ---- data quality


@query
def dq_null_profile(spark, sf_dir):
    return plain(quality.null_profiles(t.dirty_tables(spark, sf_dir)), null_pct=6)


@query
def dq_duplicate_keys(spark, sf_dir):
    return quality.duplicate_counts(t.dirty_tables(spark, sf_dir))


@query
def dedupe_keep_first(spark, sf_dir):
    rows = keep_first(t.raw_tables(spark, sf_dir).sales, "sale_id", t.SALES_ORDER)
    return plain(rows.withColumn("sale_date", F.to_date("sale_date")))


def _deduplicated(raw):
    return settle(keep_first(raw.sales, "sale_id", t.SALES_ORDER), "deduplicated_sales")


@query
def dedupe_partial_order(spark, sf_dir):
    """Ordered by the store alone: the other columns make the order total."""
    rows = keep_first(t.raw_tables(spark, sf_dir).sales, "sale_id", ["store_id"])
    return plain(rows.withColumn("sale_date", F.to_date("sale_date")))


@query
def dq_missing_sale_ids(spark, sf_dir):
    sales = t.dirty_tables(spark, sf_dir).sales
    return quality.missing_ids(sales.withColumn("sale_id", F.expr("case when sale_id % 97 = 0 then null else sale_id end")))


@query
def dq_iqr_outliers(spark, sf_dir):
    rows = _deduplicated(t.raw_tables(spark, sf_dir))
    return plain(quality.outlier_summary(rows), q1=4, q3=4, lower_bound=6, upper_bound=6, outlier_pct=6)


@query
def dq_iqr_outliers_dirty(spark, sf_dir):
    rows = _deduplicated(t.dirty_tables(spark, sf_dir))
    return plain(quality.outlier_summary(rows), q1=4, q3=4, lower_bound=6, upper_bound=6, outlier_pct=6)


@query
def dq_invalid_dates(spark, sf_dir):
    return quality.date_summary(keep_first(t.dirty_tables(spark, sf_dir).sales, "sale_id", t.SALES_ORDER))


@query
def dq_business_rules(spark, sf_dir):
    rows = keep_first(t.dirty_tables(spark, sf_dir).sales, "sale_id", t.SALES_ORDER)
    return quality.rule_summary(quality.drop_invalid_dates(rows))


@query
def dq_report(spark, sf_dir):
    return plain(quality.quality_report(t.dirty_tables(spark, sf_dir), t.SALES_ORDER), value=6)


@query
def dq_quality_score(spark, sf_dir):
    report_rows = quality.quality_report(t.raw_tables(spark, sf_dir), t.SALES_ORDER)
    return plain(quality.quality_score(report_rows), quality_score=6)


@query
def dq_quality_score_dirty(spark, sf_dir):
    report_rows = quality.quality_report(t.dirty_tables(spark, sf_dir), t.SALES_ORDER)
    return plain(quality.quality_score(report_rows), quality_score=6)


@query
def fk_semi_join(spark, sf_dir):
    star = t.dirty_star(spark, sf_dir)
    return plain(quality.keep_valid_references(star.fact, star).select(*FACT_COLUMNS))


@query
def fk_anti_rejects(spark, sf_dir):
    star = t.dirty_star(spark, sf_dir)
    return quality.rejected_references(star.fact, star).select("sale_id", "store_id", "product_id", "missing")


@query
def etl_clean_sales(spark, sf_dir):
    cleaned = quality.clean(t.raw_tables(spark, sf_dir), t.SALES_ORDER).sales
    return plain(cleaned.withColumn("sale_date", F.to_date("sale_date")))


@query
def etl_clean_sales_dirty(spark, sf_dir):
    cleaned = quality.clean(t.dirty_tables(spark, sf_dir), t.SALES_ORDER).sales
    return plain(cleaned.withColumn("sale_date", F.to_date("sale_date")))


# ---- dimensions and fact


@query
def dim_date(spark, sf_dir):
    return t.conformed(spark, sf_dir).dim_date


@query
def date_surrogate_key(spark, sf_dir):
    return t.conformed(spark, sf_dir).fact.select("sale_id", "date_id", "date")


@query
def dim_store(spark, sf_dir):
    return t.stored(spark, sf_dir).star.dim_store


@query
def dim_product(spark, sf_dir):
    return plain(t.stored(spark, sf_dir).star.dim_product)


@query
def dim_customer(spark, sf_dir):
    return t.stored(spark, sf_dir).star.dim_customer


@query
def fact_sales(spark, sf_dir):
    return plain(t.conformed(spark, sf_dir).fact.select(*FACT_COLUMNS))


@query
def age_band(spark, sf_dir):
    ages = t.table(spark, sf_dir, "customer").selectExpr("c_custkey as customer_id", "cast(c_custkey % 90 as int) as age")
    return ages.withColumn("age_group", c.age_band(F.col("age")))


@query
def sale_measures(spark, sf_dir):
    items = t.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey as product_id", "cast(l_quantity as int) as quantity"
    )
    prices = t.products(spark, sf_dir).select("product_id", "price", F.col("cost").alias("unit_cost"))
    measured = (
        items.join(prices, "product_id")
        .withColumn("revenue", c.line_amount(F.col("price"), F.col("quantity")))
        .withColumn("cost", c.line_amount(F.col("unit_cost"), F.col("quantity")))
        .withColumn("profit", F.col("revenue") - F.col("cost"))
    )
    return plain(measured.select("l_orderkey", "l_linenumber", "product_id", "quantity", "revenue", "cost", "profit"))


# ---- filters, all shown through the headline figures

report("kpis", reports.kpis)
report("filter_date_range", reports.kpis, SalesFilter(date(1997, 3, 5), date(1997, 9, 20)))
report("filter_stores", reports.kpis, SalesFilter(date(1996, 1, 1), date(1997, 12, 31), stores="1,3,5"))
report(
    "filter_categories",
    reports.kpis,
    SalesFilter(date(1996, 1, 1), date(1997, 12, 31), categories="PROMO,ECONOMY"),
)
report(
    "filter_regions", reports.kpis, SalesFilter(date(1996, 1, 1), date(1997, 12, 31), regions="ASIA,EUROPE")
)
report(
    "filter_combined",
    reports.kpis,
    SalesFilter(date(1996, 6, 1), date(1997, 6, 30), "0,1,2,3,4,5,6,7", ["PROMO", "SMALL"], ["ASIA", "AFRICA", "AMERICA"]),
)
report(
    "scope_store_manager",
    reports.kpis,
    SalesFilter(date(1996, 1, 1), date(1997, 12, 31), stores="1,2"),
    MANAGER,
)
report("scope_without_store", reports.kpis, PERIOD, Scope("store_manager"))
report("filter_last_year", reports.kpis, SalesFilter.trailing_years(t.AS_OF))
report("filter_until_today", reports.kpis, SalesFilter(date(1997, 1, 1)))
report("filter_trailing_days", reports.kpis, trailing_days(t.AS_OF, 60))


# ---- star joins


@query
def star_join_3dim(spark, sf_dir):
    rows = star_rows(t.stored(spark, sf_dir).star, EVER, ADMIN)
    return plain(
        rows.select("sale_id", "date", "day_of_week", "is_weekend", "store_name", "region", "product_name", "category", "revenue")
    )


@query
def star_join_4dim(spark, sf_dir):
    rows = star_rows(t.stored(spark, sf_dir).star, EVER, ADMIN, ("date", "store", "product", "customer"))
    return plain(
        rows.select("sale_id", "date", "store_name", "city", "category", "customer_name", "customer_city", "age_group", "revenue")
    )


# ---- reports

report("sales_trend", reports.sales_trend)
report("store_performance", reports.store_performance)
report("product_performance", reports.product_performance)
report("top_products", reports.top_products)
report("category_revenue", reports.category_revenue)
report("customer_insights", reports.customer_insights)
report("customer_insights_ever", reports.customer_insights, EVER)
report(
    "customer_insights_filtered",
    reports.customer_insights,
    SalesFilter(date(1996, 1, 17), date(1997, 6, 9), categories="PROMO,ECONOMY,STANDARD", regions="ASIA,EUROPE,AFRICA"),
)
report("customer_insights_days", reports.customer_insights, SalesFilter(date(1996, 5, 3), date(1996, 5, 30), stores="0,1,2,3,4"))
report("customer_insights_store", reports.customer_insights, EVER, MANAGER)
report("insight_top_store", reports.top_store)
report("insight_top_category", reports.top_category)
report("insight_cards", reports.insight_cards)
report("insight_cards_store", reports.insight_cards, PERIOD, MANAGER)
report("seasonal_quarterly", reports.quarterly_sales)
report("seasonal_monthly", reports.monthly_pattern)
report("daily_sales", reports.daily_sales)
report("customer_features", segments.customer_features)
report(
    "customer_features_scaled",
    lambda *a: segments.standardise(settle(segments.customer_features(*a), "customer_features")).select(
        "customer_id", *(f"{f}_z" for f in segments.FEATURES)
    ),
    EVER,
    **{f"{f}_z": 6 for f in segments.FEATURES},
)
report("anomaly_daily", lambda *a: anomaly.flag_days(reports.daily_sales(*a)), expected_revenue=4, deviation=6)
report("anomaly_stats", lambda *a: anomaly.daily_statistics(reports.daily_sales(*a)), mean_revenue=4, std_revenue=4)
report(
    "seasonal_insights",
    lambda *a: reports.seasonal_insights(reports.monthly_pattern(*a)),
    percentage=6,
)
report("customer_grouping_sets", lambda *a: reports.customer_grouping_sets(reports.customer_insights(*a)))
report(
    "category_share", lambda *a: reports.share_of_total(reports.category_revenue(*a), "category"), share_pct=6
)
report("gender_share", lambda *a: reports.share_of_total(reports.customer_insights(*a), "gender"), share_pct=6)


def _view(name: str) -> None:
    def through_sql(spark, sf_dir):
        reports.install_views(t.stored(spark, sf_dir).star)
        return plain(run_query(spark, f"SELECT * FROM {name}"))

    QUERIES[name] = through_sql


_view("v_monthly_sales")
_view("v_store_performance")
_view("v_product_performance")


@query
def filter_options_admin(spark, sf_dir):
    return reports.filter_option_rows(t.stored(spark, sf_dir).star, ADMIN)


@query
def filter_options_store(spark, sf_dir):
    return reports.filter_option_rows(t.stored(spark, sf_dir).star, MANAGER)


# ---- inventory


def _demand(spark, sf_dir, scope=ADMIN):
    held = t.stored(spark, sf_dir)
    return inventory.demand(held.star, scope, t.AS_OF, 60, held.levels)


@query
def demand_with_stock(spark, sf_dir):
    return plain(_demand(spark, sf_dir))


@query
def demand_no_stock(spark, sf_dir):
    return plain(inventory.demand(t.stored(spark, sf_dir).star, ADMIN, t.AS_OF, 60))


@query
def inventory_optimization(spark, sf_dir):
    return plain(inventory.optimise(_demand(spark, sf_dir)), daily_demand=2)


@query
def inventory_upsert(spark, sf_dir):
    held = t.stored(spark, sf_dir)
    now = F.lit(t.AS_OF).cast("timestamp_ntz")
    return inventory.updated_levels(held.levels, inventory.optimise(_demand(spark, sf_dir)), now)


@query
def inventory_upsert_stored(spark, sf_dir):
    """The same update of the stored table, in two runs of some stores each."""
    now = F.lit(t.AS_OF).cast("timestamp_ntz")
    levels = inventory.stored_levels(spark, f"{shared_folder(spark)}/levels-{uuid4().hex}", buckets=16)
    levels.replace(t.stored(spark, sf_dir).levels)
    optimised = settle(inventory.optimise(_demand(spark, sf_dir)), "optimised")
    for some in ("store_id % 4 = 1", "store_id % 4 <> 1"):
        inventory.update_stored_levels(levels, optimised.where(some), now)
    return levels.read()


@query
def reorder_suggestions(spark, sf_dir):
    held = t.stored(spark, sf_dir)
    return inventory.reorder_suggestions(held.star, ADMIN, held.levels)


@query
def inventory_scoped(spark, sf_dir):
    held = t.stored(spark, sf_dir)
    return inventory.reorder_suggestions(held.star, MANAGER, held.levels)


@query
def auto_orders(spark, sf_dir):
    return inventory.auto_orders(_demand(spark, sf_dir))


@query
def auto_orders_scoped(spark, sf_dir):
    return inventory.auto_orders(_demand(spark, sf_dir, MANAGER))


@query
def inventory_availability(spark, sf_dir):
    held = t.stored(spark, sf_dir)
    return inventory.availability(held.star, ADMIN, held.levels, held.central)


@query
def inventory_levels_listing(spark, sf_dir):
    held = t.stored(spark, sf_dir)
    return inventory.list_levels(held.star, ADMIN, held.levels)


@query
def stock_probe(spark, sf_dir):
    """Demand with the stock table that the catalog has, and with one that it lacks."""
    held = t.stored(spark, sf_dir)
    held.levels.createOrReplaceTempView("stock_levels")
    found = []
    for name, column in (("stock_levels", "current_quantity"), ("stock_levels", "no_such_column"), ("no_such_table", "current_quantity")):
        levels = optional_table(spark, name, column)
        wanted = inventory.demand(held.star, ADMIN, t.AS_OF, 60, levels)
        found.append(wanted.select(F.lit(f"{name}.{column}").alias("probe"), "store_id", "product_id", "current_stock"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def low_stock_alerts(spark, sf_dir):
    return inventory.low_stock_alerts(reorder_suggestions(spark, sf_dir))


@query
def auto_order_alerts(spark, sf_dir):
    return inventory.auto_order_alerts(auto_orders(spark, sf_dir))


@query
def alerts_appended(spark, sf_dir):
    """Two runs of one day append the same alerts; the second adds nothing."""
    path = f"{shared_folder(spark)}/alerts-{uuid4().hex}"
    now = F.lit(t.AS_OF).cast("timestamp_ntz")
    first = low_stock_alerts(spark, sf_dir)
    sinks.append_alerts(first, None, path, now)
    sinks.append_alerts(first.unionByName(auto_order_alerts(spark, sf_dir)), spark.read.parquet(path), path, now)
    stored = spark.read.parquet(path)
    told = stored.groupBy("store_id", "type", "title", "message", "severity", "is_read", "created_at")
    return told.agg(F.count_distinct("notification_id").alias("ids"), F.count("*").alias("copies"))


@query
def stream_alerts(spark, sf_dir):
    """The same alerts from streams of levels and orders; then all batches once more, dealt otherwise, which add nothing."""
    held, base = t.stored(spark, sf_dir), f"{shared_folder(spark)}/alert-streams-{uuid4().hex}"
    deal = F.pmod(F.xxhash64("store_id", "product_id"), F.lit(3))
    made = settle(auto_orders(spark, sf_dir), "auto_orders")
    for part in range(3):
        held.levels.where(deal == part).write.mode("append").parquet(f"{base}/levels")
        made.where(deal == part).repartition(2).write.mode("append").parquet(f"{base}/orders")
    orders = spark.read.parquet(f"{base}/orders").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    now = datetime.combine(t.AS_OF, datetime.min.time())
    for turn, files in enumerate((2, None)):
        levels = runs.file_stream(spark, f"{base}/levels", INVENTORY_LEVELS, files)
        stream_alerts_job.watch_levels(levels, held.star, ADMIN, f"{base}/alerts", f"{base}/checkpoint-levels-{turn}", now)
        ordered = runs.file_stream(spark, f"{base}/orders", orders, files)
        stream_alerts_job.watch_orders(ordered, f"{base}/alerts", f"{base}/checkpoint-orders-{turn}", now)
    told = stream_alerts_job.read_alerts(spark, f"{base}/alerts").groupBy("store_id", "type", "title", "message", "severity", "is_read", "created_at")
    return told.agg(F.count_distinct("notification_id").alias("ids"), F.count("*").alias("copies"))


@query
def stream_daily_sales(spark, sf_dir):
    """Two deliveries with late and repeated sales, each taken by a run of its own."""
    base = f"{shared_folder(spark)}/daily-stream-{uuid4().hex}"
    fact = t.stored(spark, sf_dir).star.fact
    moment = F.timestamp_seconds(F.unix_timestamp(F.col("date").cast("timestamp")) + F.col("sale_id") % 86400)
    sales = fact.select("sale_id", moment.alias("sale_date"), "quantity", "revenue", "date")
    late = F.expr("date = date'1996-12-31' and sale_id % 10 = 0")
    early = sales.where("date < date'1997-01-01'")
    again = early.where("date = date'1996-12-31' and sale_id % 7 = 0")
    first = early.where(~late).unionAll(again.where(~late))
    rest = sales.where("date >= date'1997-01-01'").unionAll(early.where(late)).unionAll(again)
    for delivery in (first, rest):
        delivery.drop("date").write.mode("append").parquet(f"{base}/sales")
        stream = runs.file_stream(spark, f"{base}/sales", "sale_id bigint, sale_date timestamp, quantity int, revenue decimal(12,2)")
        stream_daily.write_closed_days(stream, f"{base}/days", f"{base}/checkpoint")
    return plain(stream_daily.read_closed_days(spark, f"{base}/days"))


@query
def inventory_cards(spark, sf_dir):
    held = t.stored(spark, sf_dir)
    wanted = _demand(spark, sf_dir)
    return inventory.inventory_cards(
        inventory.optimise(wanted),
        inventory.reorder_suggestions(held.star, ADMIN, held.levels),
        inventory.auto_orders(wanted),
    )


# ---- forecasts


def _history(spark, sf_dir, by=()):
    return forecast.monthly_history(t.stored(spark, sf_dir).star, PERIOD, ADMIN, by)


FIT = {f"{m}_{s}": 4 for m in ("revenue", "profit") for s in ("slope", "intercept")}
FIT_R2 = {f"{m}_r2": 6 for m in ("revenue", "profit")}
AMOUNTS = {"revenue": 2, "profit": 2}


@query
def forecast_history(spark, sf_dir):
    return plain(_history(spark, sf_dir))


@query
def forecast_fallback(spark, sf_dir):
    nothing_sold = SalesFilter(date(2020, 1, 1), date(2021, 12, 31), stores="1")
    return plain(forecast.history_or_fallback(t.stored(spark, sf_dir).star, nothing_sold, MANAGER))


@query
def period_index(spark, sf_dir):
    history = forecast.monthly_history(t.stored(spark, sf_dir).star, EVER, ADMIN, ("store_id",))
    return forecast.with_period(history, ("store_id",)).select(
        "store_id", "year", "month", "period"
    )


@query
def forecast_r2(spark, sf_dir):
    return plain(forecast.linear_trend(_history(spark, sf_dir)).drop("last_month"), **FIT, **FIT_R2)


@query
def forecast_linear(spark, sf_dir):
    return plain(forecast.forecast(_history(spark, sf_dir), "linear", 6), **AMOUNTS)


@query
def forecast_calendar(spark, sf_dir):
    history = forecast.monthly_history(t.stored(spark, sf_dir).star, EVER, ADMIN, ("store_id",))
    return forecast.future_months(forecast.linear_trend(history, ("store_id",)), 12).select(
        "store_id", "last_month", "step", "date"
    )


@query
def forecast_full(spark, sf_dir):
    history = _history(spark, sf_dir)
    return plain(forecast.with_history(history, forecast.forecast(history)), **AMOUNTS)


@query
def forecast_linear_by_store(spark, sf_dir):
    history = _history(spark, sf_dir, ("store_id",))
    return plain(forecast.forecast(history, by=("store_id",)), **AMOUNTS)


@query
def forecast_arima_by_store(spark, sf_dir):
    history = _history(spark, sf_dir, ("store_id",))
    return plain(forecast.forecast(history, "arima", by=("store_id",)), **AMOUNTS)


@query
def forecast_autoregressive_by_store(spark, sf_dir):
    """Order 1,1,0: differences regressed on those before, through the origin."""
    history = _history(spark, sf_dir, ("store_id",))
    return plain(forecast.arima_forecast(history, (1, 1, 0), by=("store_id",), method="conditional"), **AMOUNTS)


@query
def forecast_likelihood_by_store(spark, sf_dir):
    """The order whose likelihood has one maximum, at the root of a cubic."""
    history = _history(spark, sf_dir, ("store_id",))
    return plain(forecast.forecast(history, "arima", arima_order="1,1,0", by=("store_id",)), revenue=1, profit=1)


@query
def forecast_last_value_by_store(spark, sf_dir):
    """Order 0,1,0: the last value goes on."""
    history = _history(spark, sf_dir, ("store_id",))
    return plain(forecast.forecast(history, "arima", arima_order="0,1,0", by=("store_id",)), **AMOUNTS)


@query
def forecast_calendar_trend_by_store(spark, sf_dir):
    """The seasonal model without waves: a line over the calendar's months."""
    history = _history(spark, sf_dir, ("store_id",))
    return plain(forecast.seasonal_forecast(history, by=("store_id",), harmonics=0, changepoints=0), **AMOUNTS)


@query
def forecast_unbent_trend_by_store(spark, sf_dir):
    """All bends penalised away: the same line."""
    history = _history(spark, sf_dir, ("store_id",))
    return plain(forecast.seasonal_forecast(history, by=("store_id",), harmonics=0, prior=1e-12), **AMOUNTS)


@query
def forecast_skipped_series(spark, sf_dir):
    """Customers' series are short: many have fewer months than an order needs."""
    history = forecast.monthly_history(t.stored(spark, sf_dir).star, PERIOD, ADMIN, ("customer_id",))
    return forecast.skipped_series(history, ("customer_id",), "arima", "2,1,2")


@query
def forecast_seasonal_by_store(spark, sf_dir):
    history = _history(spark, sf_dir, ("store_id",))
    return plain(forecast.forecast(history, "prophet", by=("store_id",)), **AMOUNTS)


# ---- segments


def _segmented(spark, sf_dir):
    return segments.segment_customers(segments.customer_features(t.stored(spark, sf_dir).star, PERIOD, ADMIN))


@query
def customer_segments(spark, sf_dir):
    return _segmented(spark, sf_dir).select("customer_id", "age_group", "gender", "segment")


@query
def segment_summary(spark, sf_dir):
    means = ("avg_transactions", "avg_revenue", "avg_order_value", "avg_quantity")
    return plain(segments.segment_summary(_segmented(spark, sf_dir)), **dict.fromkeys(means, 4))


@query
def segment_totals(spark, sf_dir):
    return plain(segments.segment_totals(_segmented(spark, sf_dir)), **{f: 2 for f in segments.FEATURES})


@query
def segment_nearest(spark, sf_dir):
    return segments.misplaced_customers(_segmented(spark, sf_dir))


# ---- notifications and users


def _feed(spark, sf_dir, scope):
    return notifications.feed(t.notifications(spark, sf_dir), t.stores(spark, sf_dir), scope)


@query
def notification_feed_admin(spark, sf_dir):
    return _feed(spark, sf_dir, ADMIN_8)


@query
def notification_feed_store(spark, sf_dir):
    return _feed(spark, sf_dir, MANAGER)


@query
def notification_unread(spark, sf_dir):
    return notifications.unread_count(t.notifications(spark, sf_dir), MANAGER)


@query
def notification_feed_receipts(spark, sf_dir):
    notes, stores = t.notifications(spark, sf_dir), t.stores(spark, sf_dir)
    return notifications.feed(notes, stores, MANAGER, receipts=t.read_receipts(spark, sf_dir))


@query
def notification_mark_read(spark, sf_dir):
    marked = notifications.mark_read(t.notifications(spark, sf_dir), t.read_receipts(spark, sf_dir))
    return marked.select("notification_id", "user_id", "store_id", "type", "is_read")


@query
def notification_mark_all(spark, sf_dir):
    marked = notifications.mark_all_read(t.notifications(spark, sf_dir), MANAGER.user_id)
    return marked.select("notification_id", "user_id", "store_id", "type", "is_read")


@query
def user_directory(spark, sf_dir):
    stores = t.stores(spark, sf_dir)
    return notifications.user_directory(t.users(stores), stores)


@query
def scope_rows(spark, sf_dir):
    return notifications.scope_rows(t.stores(spark, sf_dir))


@query
def scope_upsert(spark, sf_dir):
    """Stores outside Asia already have a user; provisioning adds the rest."""
    stores = t.stores(spark, sf_dir)
    known = t.users(stores.where("region <> 'ASIA'"))
    scopes = notifications.scope_rows(stores).withColumn("user_id", F.coalesce(F.col("store_id") + 1, F.lit(0)))
    merged = notifications.upsert_scopes(known, scopes, F.lit(t.AS_OF).cast("timestamp_ntz"))
    return merged.withColumns({n: c.timestamp_text(F.col(n)) for n in ("created_at", "last_login")})


# ---- scalar functions


@query
def scalar_date(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return t.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.dayofmonth(day).alias("day"),
        F.month(day).alias("month"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        F.weekday(day).alias("weekday"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.date_format(day, "EEEE").alias("day_of_week"),
        c.month_name(F.month(day), "he").alias("month_name_he"),
        c.quarter_name(c.quarter_of(F.month(day))).alias("quarter_name"),
        c.period_label(F.year(day), F.month(day)).alias("label"),
        F.date_sub(day, 60).alias("back_60_days"),
        F.make_date(F.year(day), F.month(day), F.lit(1)).alias("month_start"),
        F.add_months(F.trunc(day, "month"), 1).alias("next_month"),
        c.timestamp_text(F.col("o_orderdate")).alias("text"),
    )


@query
def scalar_string(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("slug"),
        F.concat_ws(" | ", "p_name", "p_brand").alias("joined"),
        F.element_at(F.split("p_name", " "), 1).alias("first_word"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.concat(F.lit("store_"), F.col("p_partkey").cast("string")).alias("username"),
        F.coalesce(F.nullif(F.col("p_type"), F.lit("PROMO")), F.lit("none")).alias("defaulted"),
        c.shekels(F.col("p_retailprice")).alias("amount_text"),
        c.money_text(F.col("p_retailprice")).alias("money_text"),
    )


@query
def scalar_math(spark, sf_dir):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return t.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.sqrt(price).alias("root"),
        F.abs(size - 25).alias("distance"),
        F.greatest(size, F.lit(10)).alias("at_least_10"),
        F.least(size, F.lit(40)).alias("at_most_40"),
        c.truncated(price * 1.1).alias("truncated"),
        c.ratio(price, size - 25).alias("ratio"),
        c.percent(size, price).alias("percent"),
        F.round(price / 7, 4).alias("rounded"),
    )
