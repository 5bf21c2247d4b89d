from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from conftest import SF

from salesmart.checks import retail_tables as t
from salesmart.functions.series import arima_path, fit_arma, months_needed, seasonal_path
from salesmart.model import ADMIN, SalesFilter, Scope
from salesmart.plans import anomaly, forecast, reports, segments

MONTHS = "year int, month int, revenue double, profit double, month_name string"


def history(spark, values, start=(2024, 1), months=None):
    at = start[0] * 12 + start[1] - 1
    steps = months or range(len(values))
    rows = [((at + s) // 12, (at + s) % 12 + 1, float(v), float(v) / 2, "m") for s, v in zip(steps, values)]
    return spark.createDataFrame(rows, MONTHS)


def daily(spark, values):
    rows = [(date(2024, 1, 1) + timedelta(i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, daily_revenue double")


def test_anomaly(spark):
    (row,) = anomaly.flag_days(daily(spark, [100] * 9 + [1000])).collect()
    assert (row.revenue, row.expected_revenue, row.type) == (1000, 190, "high")
    assert row.deviation == pytest.approx(426.3157894)
    stats = anomaly.daily_statistics(daily(spark, [100] * 9 + [1000])).first()
    assert stats.std_revenue == pytest.approx(284.605, abs=1e-3)


def test_anomaly_needs_seven_days(spark):
    assert anomaly.flag_days(daily(spark, [1, 1, 1, 1, 1, 900])).count() == 0
    assert anomaly.daily_statistics(daily(spark, [1] * 6)).count() == 0


def test_peak_tie_takes_the_earliest_month(spark):
    rows = [(4, "April", 5.0), (3, "March", 5.0), (1, "January", 2.0)]
    pattern = spark.createDataFrame(rows, "month int, month_name string, avg_revenue double")
    found = {r.type: r for r in reports.seasonal_insights(pattern).collect()}
    assert found["peak_month"].month == "March"
    assert found["peak_month"].percentage == pytest.approx(25.0)
    assert found["low_month"].month == "January"
    assert found["low_month"].percentage == pytest.approx(50.0)


def test_linear(spark):
    rows = forecast.linear_forecast(history(spark, [10, 20, 30]), 2).orderBy("year", "month").collect()
    assert [r.revenue for r in rows] == pytest.approx([40, 50])
    assert [(r.year, r.month) for r in rows] == [(2024, 4), (2024, 5)]
    assert forecast.linear_trend(history(spark, [10, 20, 30])).first().revenue_r2 == pytest.approx(1)


def test_constant_series_fits_perfectly(spark):
    trend = forecast.linear_trend(history(spark, [5, 5, 5])).first()
    assert trend.revenue_r2 == 1.0
    assert forecast.linear_forecast(history(spark, [5, 5, 5]), 1).first().revenue == pytest.approx(5)


def test_missing_months_leave_no_gap(spark):
    gapped = history(spark, [1, 2, 3], months=[0, 2, 3])
    periods = {r.month: r.period for r in forecast.with_period(gapped).collect()}
    assert periods == {1: 0, 3: 1, 4: 2}
    assert forecast.linear_forecast(gapped, 1).first().month == 5


def test_too_short_series(spark):
    star = t.stored(spark, SF).star
    one_day = SalesFilter(date(1996, 1, 1), date(1996, 1, 1))
    with pytest.raises(ValueError, match="needs 3 months"):
        forecast.history_or_fallback(star, one_day, Scope("store_manager"))
    assert forecast.linear_forecast(history(spark, [1, 2]), 3).count() == 0
    assert forecast.arima_forecast(history(spark, [1, 2]), ahead=3).count() == 0


@pytest.mark.parametrize("model, same", [("linear", "linear"), ("whatever", "linear"), ("LINEAR", "linear")])
def test_dispatch(spark, model, same):
    past = history(spark, [10, 25, 30, 50])
    assert forecast.forecast(past, model).collect() == forecast.forecast(past, same).collect()


def test_dispatch_reaches_the_fitted_models(spark):
    past = history(spark, [10, 20, 30, 40, 50, 60, 70, 80])
    for model in ("arima", "prophet"):
        rows = forecast.forecast(past, model, 3).orderBy("year", "month").collect()
        assert [r.revenue for r in rows] == pytest.approx([90, 100, 110], rel=1e-6)
        assert [r.profit for r in rows] == pytest.approx([45, 50, 55], rel=1e-6)


@pytest.mark.parametrize("text", ["1,1", "a,b,c", "1,1,1,1", "", "1,-1,1"])
def test_bad_order(text):
    with pytest.raises(ValueError, match="is no ARIMA order"):
        forecast.parse_order(text)
    assert forecast.parse_order(" 2, 1,0") == (2, 1, 0)


def test_whole_forecast_report(spark):
    star = t.stored(spark, SF).star
    rows = forecast.sales_forecast(star, SalesFilter(date(1996, 1, 1), date(1997, 12, 31)), ADMIN, 3).collect()
    assert sum(r.is_forecast for r in rows) == 3 and len(rows) == 27
    assert {r.label for r in rows if r.is_forecast} == {"1998-01", "1998-02", "1998-03"}


def test_arma_recovers_its_coefficients():
    rng = np.random.default_rng(1)
    shocks = rng.normal(size=4000)
    x = np.zeros(4000)
    for i in range(1, 4000):
        x[i] = 0.6 * x[i - 1] + shocks[i] + 0.3 * shocks[i - 1]
    ar, ma, _, _ = fit_arma(x, 1, 1)
    assert ar[0] == pytest.approx(0.6, abs=0.07)
    assert ma[0] == pytest.approx(0.3, abs=0.07)


def squared_errors(x, phi, theta):
    """One-step errors of ARMA(1, 1) written out, the first taken as zero."""
    total = previous = 0.0
    for i in range(1, len(x)):
        previous = x[i] - phi * x[i - 1] - theta * previous
        total += previous**2
    return total


@pytest.mark.parametrize("seed", range(6))
def test_arma_is_the_least_squares_fit(seed):
    """No point of a fine grid over all admissible coefficients does better."""
    x = np.random.default_rng(seed).normal(0, 10, 24).cumsum() / (1 + seed)
    ar, ma, errors, settled = fit_arma(x, 1, 1)
    assert settled
    found = squared_errors(x, ar[0], ma[0])
    assert errors @ errors == pytest.approx(found)
    grid = np.linspace(-0.99, 0.99, 100)
    assert found <= min(squared_errors(x, a, b) for a in grid for b in grid) * 1.01


@pytest.mark.parametrize("order", [(1, 1, 1), (0, 1, 0), (2, 1, 0), (0, 0, 1), (3, 2, 2), (0, 0, 0)])
@pytest.mark.parametrize("n", [3, 4, 6, 30])
def test_arima_fits_the_given_order_or_none(order, n):
    y = np.random.default_rng(n).normal(100, 10, n)
    if n < months_needed(order):
        with pytest.raises(ValueError, match="can't carry"):
            arima_path(y, order, 6)
        return
    path, fitted = arima_path(y, order, 6)
    assert len(path) == 6 and np.isfinite(path).all()
    assert fitted.startswith("arima({},{},{})".format(*order))


def test_short_series_are_told(spark):
    rows = [(s, 2024, m, float(10 * s + m), 1.0) for s, n in ((1, 2), (2, 5), (3, 12)) for m in range(1, n + 1)]
    history = spark.createDataFrame(rows, "store_id int, year int, month int, revenue double, profit double")
    for model, order, left in (("linear", "1,1,1", {1}), ("arima", "2,1,2", {1, 2}), ("prophet", "1,1,1", {1})):
        skipped = {r.store_id: r.reason for r in forecast.skipped_series(history, ["store_id"], model, order).collect()}
        assert set(skipped) == left and skipped[1] == "fewer than 3 months"
        done = forecast.forecast(history, model, 3, order, ["store_id"]).collect()
        assert {r.store_id for r in done} == {1, 2, 3} - left
        if model == "prophet":
            assert {r.fitted for r in done} == {"trend, 0 waves"}  # a year is too short for waves


def test_random_walk_and_mean():
    y = np.array([3.0, 9.0, 4.0, 8.0])
    assert arima_path(y, (0, 1, 0), 3)[0] == pytest.approx([8, 8, 8])
    assert arima_path(y, (0, 0, 0), 2)[0] == pytest.approx([6, 6])


def test_seasonal_reproduces_its_own_model():
    m = np.arange(24000, 24036)
    y = 100 + 2.0 * (m - m[0]) + 10 * np.cos(2 * np.pi * m / 12) + 4 * np.sin(4 * np.pi * m / 12)
    ahead = m[-1] + np.arange(1, 7)
    expected = 100 + 2.0 * (ahead - m[0]) + 10 * np.cos(2 * np.pi * ahead / 12) + 4 * np.sin(4 * np.pi * ahead / 12)
    assert seasonal_path(m, y, 6)[0] == pytest.approx(expected, rel=1e-8)


def test_same_seed_same_segments(spark):
    star = t.stored(spark, SF).star
    features = segments.customer_features(star, SalesFilter(date(1996, 1, 1), date(1997, 12, 31)), ADMIN)
    runs = [
        sorted((r.customer_id, r.segment) for r in segments.segment_customers(features, 3, restarts=2).collect())
        for _ in range(2)
    ]
    assert runs[0] == runs[1]
    spread = [
        sorted((r.customer_id, r.segment) for r in segments.segment_customers(features.repartition(n), 3, restarts=2).collect())
        for n in (1, 4, 16)
    ]
    assert spread == [runs[0]] * 3  # however the features come, and numbered by mean revenue
    assert segments.segment_customers(features.limit(2), 3).count() == 0


def test_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "a int, b double")
    rows = segments.standardise(df, ["a", "b"]).orderBy("a").collect()
    assert [(r.a_z, r.b_z) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_separate_groups_are_found(spark):
    """Three clouds of customers, far apart: every start's best must tell them apart."""
    rng = np.random.default_rng(5)
    rows = [
        (g * 100 + i, *(float(v) for v in rng.normal(50 * (g + 1), 1, 4)), "a", "g")
        for g in range(3)
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, ["customer_id", *segments.FEATURES, "age_group", "gender"])
    found = {r.customer_id: r.segment for r in segments.segment_customers(df, 3).collect()}
    groups = [{found[g * 100 + i] for i in range(40)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    sizes = [r.customers_count for r in segments.segment_summary(segments.segment_customers(df, 3)).collect()]
    assert sizes == [40, 40, 40]
