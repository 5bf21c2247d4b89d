"""Filters, scopes, inventory, notifications, sinks."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import SF
from pyspark.sql import functions as F

from salesmart.checks import retail_tables as t
from salesmart.checks.queries import PERIOD
from salesmart.model import ADMIN, SalesFilter, Scope
from salesmart.operators.sales import select_sales
from salesmart.operators.upsert import upsert
from salesmart.plans import forecast, inventory, notifications, reports
from salesmart.sources import sinks
from salesmart.sources.schemas import FACT_COLUMNS
from salesmart.sources.tables import column_exists, optional_table, read_raw, table_exists


@pytest.fixture(scope="module")
def star(spark):
    return t.stored(spark, SF).star


def test_filter_lists_from_text():
    flt = SalesFilter(stores="2,3", categories="A,B", regions="")
    assert (flt.stores, flt.categories, flt.regions) == ((2, 3), ("A", "B"), ())
    assert SalesFilter.trailing_years(date(2024, 2, 29)).date_start == date(2023, 3, 1)
    assert SalesFilter.trailing_years(date(2024, 5, 6), 2).date_start == date(2022, 5, 6)


def test_manager_overrides_the_requested_stores(star):
    flt = replace(PERIOD, stores="2,3")
    stores = select_sales(star, flt, Scope("store_manager", 1)).select("store_id").distinct().collect()
    assert [r.store_id for r in stores] == [1]
    assert select_sales(star, flt, Scope("store_manager")).count() == 0


def test_default_filter_ends_today(star):
    assert select_sales(star, SalesFilter(), ADMIN).count() == 0
    assert select_sales(star, SalesFilter(date(1990, 1, 1)), ADMIN).count() == star.fact.count()


def test_empty_period_gives_no_kpis(star):
    assert reports.kpis(star, SalesFilter(date(1980, 1, 1), date(1980, 2, 1)), ADMIN).count() == 0


def test_repeated_ids_are_counted_once(star):
    doubled = replace(star, fact=star.fact.unionByName(star.fact), unique_sales=False)
    once = reports.kpis(star, PERIOD, ADMIN).first()
    twice = reports.kpis(doubled, PERIOD, ADMIN).first()
    assert twice.total_transactions == once.total_transactions
    assert twice.total_revenue == 2 * once.total_revenue


def test_additive_reports_read_the_daily_totals(star):
    builders = [
        reports.kpis, reports.sales_trend, reports.store_performance, reports.product_performance, reports.category_revenue,
        reports.daily_sales, reports.quarterly_sales, reports.monthly_pattern, forecast.monthly_history,
    ]
    for build in builders:
        df = build(star, PERIOD, ADMIN)
        without = build(replace(star, daily=None), PERIOD, ADMIN)
        assert "/fact" not in plan_of(df) and "/daily" in plan_of(df) and "/fact" in plan_of(without)
        assert df.collect() == without.collect() or sorted(df.collect()) == sorted(without.collect())
    for view in (reports.monthly_summary, reports.store_summary, reports.product_summary):
        assert "/fact" not in plan_of(view(star)) and sorted(view(star).collect()) == sorted(view(replace(star, daily=None)).collect())
    manager = Scope("store_manager", 3)
    assert "/fact" not in plan_of(reports.filter_option_rows(star, manager))
    assert reports.filter_option_rows(star, manager).collect() == reports.filter_option_rows(replace(star, sold=None), manager).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(star):
    plan = plan_of(reports.kpis(star, replace(PERIOD, stores="1,2"), ADMIN))
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "GreaterThanOrEqual(date,1996-01-01)" in plan and "In(store_id, [1,2])" in plan
    assert "customer_id" not in plan and "sale_id" not in plan


def test_reports_use_no_python(star):
    for report in (reports.kpis, reports.store_performance, reports.customer_insights, reports.export_sales):
        plan = plan_of(report(star, PERIOD, ADMIN))
        assert "Python" not in plan and "Pandas" not in plan


def test_only_asked_dimensions_are_joined(star):
    assert "Join" not in plan_of(reports.kpis(star, PERIOD, ADMIN))
    assert plan_of(reports.category_revenue(star, PERIOD, ADMIN)).count("Join") == 1


def test_plans_hold_no_cross_join(star, spark):
    for query in ("dq_iqr_outliers", "customer_features_scaled", "forecast_full", "inventory_cards"):
        from salesmart.checks.queries import QUERIES

        plan = plan_of(QUERIES[query](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# ---- inventory


def wanted(spark, quantity, days, cost, stock=0, reorder=0, top=0):
    return spark.createDataFrame(
        [(1, "s", 1, "p", quantity, days, stock, reorder, top, Decimal(cost))],
        "store_id bigint, store_name string, product_id bigint, product_name string, total_qty bigint, "
        "sales_days bigint, current_stock int, stored_reorder int, stored_max int, unit_cost decimal(12,2)",
    )


@pytest.mark.parametrize(
    "quantity, days, cost, expected",
    [(30, 10, "50", (3.0, 104, 23, 18, 127)), (1, 1, "0.5", (1.0, 191, 7, 5, 198))],
)
def test_order_quantity(spark, quantity, days, cost, expected):
    r = inventory.optimise(wanted(spark, quantity, days, cost)).first()
    assert (r.daily_demand, r.eoq, r.reorder_point, r.min_level, r.max_level) == expected


def test_auto_order_thresholds(spark):
    computed = inventory.auto_orders(wanted(spark, 30, 10, "50", stock=20)).first()
    assert (computed.reorder_point, computed.suggested_order_qty) == (23, 107)
    stored = inventory.auto_orders(wanted(spark, 30, 10, "50", stock=20, reorder=25, top=300)).first()
    assert (stored.reorder_point, stored.suggested_order_qty) == (25, 280)
    assert inventory.auto_orders(wanted(spark, 30, 10, "50", stock=24)).count() == 0


LEVELS = "store_id bigint, product_id bigint, current_quantity int, min_quantity int, max_quantity int, reorder_point int, last_updated timestamp_ntz"


def test_update_keeps_stock(spark):
    then, now = datetime(2020, 1, 1), F.lit(datetime(2021, 1, 1)).cast("timestamp_ntz")
    levels = spark.createDataFrame([(1, 1, 9, 1, 2, 3, then), (1, 2, 4, 5, 6, 7, then)], LEVELS)
    optimised = spark.createDataFrame(
        [(1, 1, 0, 18, 127, 23), (1, 2, 0, 5, 6, 7), (1, 3, 2, 10, 20, 12)],
        "store_id bigint, product_id bigint, current_stock int, min_level int, max_level int, reorder_point int",
    )
    rows = {r.product_id: r for r in inventory.updated_levels(levels, optimised, now).collect()}
    assert tuple(rows[1])[2:6] == (9, 18, 127, 23) and rows[1].last_updated.year == 2021
    assert tuple(rows[2])[2:6] == (4, 5, 6, 7) and rows[2].last_updated.year == 2020
    assert tuple(rows[3])[2:6] == (2, 10, 20, 12) and rows[3].last_updated.year == 2021


def test_reorder_never_negative(spark, star):
    levels = spark.createDataFrame([(1, 1, 5, 0, 3, 5, None), (1, 2, 6, 0, 9, 5, None)], LEVELS)
    (row,) = inventory.reorder_suggestions(star, ADMIN, levels).collect()
    assert (row.product_id, row.suggested_order_qty) == (1, 0)


def test_availability_without_central(spark, star):
    levels = t.stored(spark, SF).levels
    assert {r.central_stock for r in inventory.availability(star, ADMIN, levels).collect()} == {0}


def test_upsert_inserts_and_replaces(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, t string")
    source = spark.createDataFrame([("a", 10), ("c", 30)], "k string, n int")
    rows = sorted(tuple(r) for r in upsert(target, source, ["k"], ["n"], {"t": F.lit("new")}).collect())
    assert rows == [("a", 10, "x"), ("b", 2, "y"), ("c", 30, "new")]


# ---- notifications

NOTE = "notification_id bigint, user_id bigint, is_read boolean"


def test_mark_all(spark):
    notes = spark.createDataFrame([(1, 1, False), (2, 2, False), (3, None, False)], NOTE)
    rows = {r.notification_id: r.is_read for r in notifications.mark_all_read(notes, 1).collect()}
    assert rows == {1: True, 2: False, 3: True}


def test_mark_read_with_repeated_receipts(spark):
    notes = spark.createDataFrame([(1, 1, False), (2, 2, True), (3, None, False)], NOTE)
    receipts = spark.createDataFrame([(1,), (1,), (9,)], "notification_id bigint")
    rows = {r.notification_id: r.is_read for r in notifications.mark_read(notes, receipts).collect()}
    assert rows == {1: True, 2: True, 3: False}


# ---- sinks and catalog


def test_export_files(spark, star, tmp_path):
    export = reports.export_sales(star, PERIOD, ADMIN, 250)
    sinks.write_csv(export, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.startswith("sale_id,date,store_name") and len(text.splitlines()) == 251
    sinks.write_report(export, str(tmp_path / "report"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("*.txt"))).splitlines()
    assert len(lines) == 250 and lines[0].startswith("1997-12-31 | Supplier#")
    assert all(line.count(" | ") == 4 and "₪" in line for line in lines)


def test_empty_export_is_an_error(star, tmp_path):
    empty = reports.export_sales(star, SalesFilter(date(1980, 1, 1), date(1980, 1, 2)), ADMIN)
    for write in (sinks.write_csv, sinks.write_report):
        with pytest.raises(ValueError, match="has no rows"):
            write(empty, str(tmp_path / "none"))


def test_appended_alerts_are_numbered_on(spark, star, tmp_path):
    path = str(tmp_path / "notifications")
    levels = spark.createDataFrame([(1, 1, 1, 0, 9, 5, None), (1, 2, 1, 0, 9, 5, None)], LEVELS)
    alerts = inventory.low_stock_alerts(inventory.reorder_suggestions(star, ADMIN, levels))
    now = F.lit(datetime(2024, 1, 1))
    sinks.append_alerts(alerts, None, path, now)
    sinks.append_alerts(alerts, spark.read.parquet(path), path, now)  # the same day again adds nothing
    assert spark.read.parquet(path).count() == 2
    sinks.append_alerts(alerts, spark.read.parquet(path), path, F.lit(datetime(2024, 1, 2)))
    rows = spark.read.parquet(path).collect()
    assert len({r.notification_id for r in rows}) == len(rows) == 4
    assert {r.severity for r in rows} == {"warning"}


def test_read_raw_csv_keeps_bad_dates(spark, tmp_path):
    raw = t.raw_tables(spark, SF)
    for name, _, df in raw.items():
        df.limit(20).write.option("header", True).csv(f"{tmp_path}/{name}")
    again = read_raw(spark, str(tmp_path), "csv")
    assert dict(again.sales.dtypes)["sale_date"] == "string"
    assert again.sales.count() == 20 and dict(again.sales.dtypes)["revenue"] == "decimal(12,2)"


def test_catalog_probes(spark, star):
    reports.install_views(star)
    assert table_exists(spark, "dim_store") and not table_exists(spark, "nowhere")
    assert column_exists(spark, "fact_sales", "revenue")
    assert not column_exists(spark, "fact_sales", "nothing") and not column_exists(spark, "nowhere", "x")
    assert optional_table(spark, "nowhere", "x") is None
    assert set(FACT_COLUMNS) <= set(optional_table(spark, "fact_sales", "revenue").columns)
