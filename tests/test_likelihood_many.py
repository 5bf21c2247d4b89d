"""Many series fitted at once, against each by itself."""

from __future__ import annotations

import time

import numpy as np
import pytest

from salesmart.functions import likelihood, likelihood_many
from salesmart.plans import forecast


def many(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.normal(1e5, 2e4, (40, n))
    y[20:] = np.cumsum(rng.normal(10, 50, (20, n)), axis=1) + 500
    y[0], y[1], y[2], y[3, 1:] = 7, np.arange(n), 100 * 1.1 ** np.arange(n), 9
    return y


@pytest.mark.parametrize("order", [(1, 1, 1), (1, 1, 0), (0, 1, 1), (2, 1, 1), (1, 0, 1), (2, 0, 0), (0, 2, 1), (0, 1, 0), (3, 1, 1)])
def test_paths_are_those_of_single_fits(order):
    y = many(24, 24)[:: 8 if order[0] > 2 else 1]
    for found, row in zip(likelihood_many.likelihood_paths(y, order, 6), y, strict=True):
        alone = likelihood.likelihood_path(row, order, 6)
        # the last rounds of a search that doesn't come to rest follow the last digits
        assert found[0] == pytest.approx(alone[0], rel=1e-4 if "not" in found[1] + alone[1] else 2e-5)


@pytest.mark.parametrize("order", [(1, 1, 1), (2, 0, 1)])
def test_short_series_find_as_likely_a_model(order):
    p, d, q = order
    x = np.diff(many(9, 9)[4:], d, axis=1)
    points, _ = likelihood_many.fit(x, likelihood_many.fit_arma(x - (0 if d else x.mean(axis=1)[:, None]), p, q)[0], p, q, not d)
    for row, point in zip(x, points, strict=True):
        found = likelihood.log_likelihood(row, *likelihood._split(list(point), p), not d)
        assert found >= likelihood.log_likelihood(row, *likelihood.fit(row, p, q, not d)[:2], not d) - 1e-5


@pytest.mark.parametrize("with_mean", [False, True])
def test_likelihood_is_that_of_a_single_series(with_mean):
    y, rng = many(30, 4)[4:], np.random.default_rng(5)
    points = rng.normal(size=(len(y), 3))
    cost = likelihood_many._cost(y, points, 2, with_mean)
    slope = likelihood_many._slope(y, points, 2, with_mean)
    for row, point, height, grade in zip(y, points, cost, slope):
        def alone(p):
            return likelihood._parts(list(row), *likelihood._split(list(p), 2), with_mean)[0]

        assert height == pytest.approx(alone(point).real, rel=1e-12)
        assert grade == pytest.approx([alone(point + 1e-30j * e).imag / 1e-30 for e in np.eye(3)], rel=1e-9, abs=1e-9)


def test_series_in_blocks_and_none(monkeypatch):
    y = many(12, 1)
    whole = likelihood_many.likelihood_paths(y, (1, 1, 0), 2)
    monkeypatch.setattr(likelihood_many, "ROWS", 7)
    monkeypatch.setattr(likelihood_many, "AT_ONCE", 5)
    for a, b in zip(whole, likelihood_many.likelihood_paths(y, (1, 1, 0), 2), strict=True):
        assert a[0] == pytest.approx(b[0]) and a[1] == b[1]
    assert likelihood_many.likelihood_paths(y[:0], (1, 1, 1), 2) == []


def test_a_thousand_series_take_a_fraction_of_single_fits():
    y = np.random.default_rng(2).normal(1e5, 2e4, (1000, 24))

    def seconds(f):
        begun = time.process_time()
        f()
        return time.process_time() - begun

    alone = seconds(lambda: [likelihood.likelihood_path(row, (1, 1, 1), 6) for row in y[:20]]) / 20
    assert seconds(lambda: likelihood_many.likelihood_paths(y, (1, 1, 1), 6)) / 1000 < alone / 5


def test_forecasts_hold_each_series_by_its_key(spark):
    """Keys of any kind and null, series of several lengths, months in any order."""
    rng = np.random.default_rng(3)
    series = {k: rng.normal(100, 9, n).round(2) for k, n in (("a", 14), ("b", 14), (None, 20), ("c", 2), ("d", 5))}
    rows = [(k, 2**60 + 1, 2020 + m // 12, m % 12 + 1, float(v), float(-v)) for k, y in series.items() for m, v in enumerate(y)]
    rng.shuffle(rows)
    history = spark.createDataFrame([(*r[:2], int(r[2]), int(r[3]), *map(float, r[4:])) for r in rows], "k string, big bigint, year int, month int, revenue double, profit double")
    found = forecast.forecast(history, "arima", 3, by=("k", "big"))
    assert [f"{n} {t}" for n, t in found.dtypes] == [
        "k string", "big bigint", "year int", "month int", "revenue double", "profit double", "fitted string", "month_name string", "is_forecast boolean"
    ]
    got = {}
    for r in found.orderBy("year", "month").collect():
        assert r["big"] == 2**60 + 1
        got.setdefault(r["k"], []).append(r)
    assert set(got) == {"a", "b", None, "d"}
    for k, rs in got.items():
        y = series[k]
        assert [r["year"] * 12 + r["month"] - 1 for r in rs] == [2020 * 12 + len(y) + i for i in range(3)]
        assert [r["revenue"] for r in rs] == pytest.approx(likelihood.likelihood_path(y, (1, 1, 1), 3)[0], rel=1e-4)
        assert [r["profit"] for r in rs] == pytest.approx([-r["revenue"] for r in rs], rel=1e-3)
    assert forecast.forecast(history.where("false"), "arima", 3).count() == 0
    assert forecast.forecast(history.where("k = 'a'").drop("k", "big"), "arima", 3).count() == 3
