"""Figures of FIXTURES.md section 4 at sf0.001."""

from __future__ import annotations

import pytest
from conftest import SF

from salesmart.checks import retail_tables as t
from salesmart.checks.queries import QUERIES


def one(spark, name):
    (row,) = QUERIES[name](spark, SF).collect()
    return row


def test_row_counts(spark):
    star = t.stored(spark, SF).star
    assert t.raw_tables(spark, SF).sales.count() == 6000
    assert star.fact.count() == 4599
    assert star.dim_date.count() == 2121
    assert star.dim_date.where("is_weekend").count() == 607


def test_kpis(spark):
    row = one(spark, "kpis")
    assert row.total_quantity == 34304
    assert row.total_revenue == 68712331.07
    assert row.total_profit == 31454440.73
    assert row.profit_margin == pytest.approx(45.776996, abs=1e-6)
    assert row.avg_order_value == pytest.approx(49900.022564, abs=1e-6)


def test_scoped_kpis(spark):
    row = one(spark, "scope_store_manager")
    assert (row.total_transactions, row.total_revenue) == (166, 9173168.72)


def test_tops(spark):
    assert one(spark, "insight_top_store").revenue == 9173168.72
    row = one(spark, "insight_top_category")
    assert (row.category, row.revenue) == ("PROMO", 13985127.24)


def test_peak_month(spark):
    peak = next(r for r in QUERIES["seasonal_insights"](spark, SF).collect() if r.type == "peak_month")
    assert (peak.month, peak.revenue) == ("October", pytest.approx(3815593.015))


def test_anomalies(spark):
    row = one(spark, "anomaly_stats")
    assert (row.total_days, row.mean_revenue, row.std_revenue) == (631, 108894.3440, 74551.8279)
    assert QUERIES["anomaly_daily"](spark, SF).count() == 29


def test_quartiles(spark):
    row = one(spark, "dq_iqr_outliers")
    assert (row.q1, row.q3, row.outliers) == (25666.22, 75450.795, 0)


def test_trend(spark):
    row = one(spark, "forecast_r2")
    assert row.months == 24
    assert row.revenue_slope == pytest.approx(-15748.873248, abs=1e-3)
    assert row.revenue_intercept == pytest.approx(3044125.836933, abs=1e-3)
    assert row.revenue_r2 == pytest.approx(0.045198, abs=1e-6)
    assert row.profit_slope == pytest.approx(-7899.420770, abs=1e-3)


def test_demand(spark):
    rows = QUERIES["inventory_optimization"](spark, SF).collect()
    assert len(rows) == 104
    assert sum(r.eoq for r in rows) == 9443
    assert sum(r.reorder_point for r in rows) == 20234


def test_feed(spark):
    admin = QUERIES["notification_feed_admin"](spark, SF).collect()
    assert (len(admin), sum(not r.is_read for r in admin)) == (50, 24)
    assert one(spark, "notification_unread").unread_count == 44


def test_customers_and_score(spark):
    assert QUERIES["customer_features"](spark, SF).count() == 150
    assert one(spark, "dq_quality_score").quality_score == 85.0
