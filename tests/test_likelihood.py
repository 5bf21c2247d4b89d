"""ARIMA by exact likelihood against the dense normal density, and bending trends against their conditions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from salesmart.functions import likelihood, trend
from salesmart.functions.series import arima_path, months_needed, seasonal_path


def autocovariances(ar, ma, n):
    """By the weights of a long moving average."""
    psi = np.zeros(4000)
    psi[0] = 1
    for k in range(1, len(psi)):
        psi[k] = (ma[k - 1] if k <= len(ma) else 0) + sum(a * psi[k - i] for i, a in enumerate(ar, 1) if k >= i)
    return np.array([psi[: len(psi) - h] @ psi[h:] for h in range(n)])


def dense(y, ar, ma, with_mean):
    n, gamma = len(y), autocovariances(ar, ma, len(y))
    cov = gamma[abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    inverse, ones = np.linalg.inv(cov), np.ones(n)
    mean = ones @ inverse @ y / (ones @ inverse @ ones) if with_mean else 0.0
    squares = (y - mean) @ inverse @ (y - mean)
    return -(n * math.log(squares / n) + np.linalg.slogdet(cov)[1]) / 2 - n / 2 * (1 + math.log(2 * math.pi))


CASES = [([], []), ([0.7], []), ([-0.4], [0.5]), ([], [0.9]), ([0.5, -0.3], [0.2, 0.4, -0.1]), ([1.2, -0.5, 0.1], [-0.6])]


@pytest.mark.parametrize("ar, ma", CASES)
@pytest.mark.parametrize("with_mean", [False, True])
@pytest.mark.parametrize("n", [3, 7, 40])
def test_likelihood_is_the_normal_density(ar, ma, with_mean, n):
    y = np.random.default_rng(n).normal(3, 2, n)
    assert likelihood.log_likelihood(y, ar, ma, with_mean) == pytest.approx(dense(y, ar, ma, with_mean), rel=1e-8)


def simulated(ar, ma, n, seed):
    rng = np.random.default_rng(seed)
    shocks, x = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(5, n + 200):
        x[t] = sum(a * x[t - i] for i, a in enumerate(ar, 1)) + shocks[t] + sum(m * shocks[t - i] for i, m in enumerate(ma, 1))
    return x[200:]


@pytest.mark.parametrize("ar, ma", [([0.6], []), ([], [0.5]), ([0.6], [0.3]), ([0.5, -0.4], [])])
def test_estimates_are_within_their_error(ar, ma):
    n = 1500
    found_ar, found_ma, settled = likelihood.fit(simulated(ar, ma, n, 3), len(ar), len(ma), False)
    assert settled
    assert [*found_ar, *found_ma] == pytest.approx([*ar, *ma], abs=4 / math.sqrt(n))


@pytest.mark.parametrize("seed", range(8))
def test_no_point_of_a_grid_is_more_likely(seed):
    y = np.random.default_rng(seed).normal(0, 10, 24)
    ar, ma, _ = likelihood.fit(y, 1, 1, False)
    best = likelihood.log_likelihood(y, ar, ma)
    grid = np.linspace(-0.98, 0.98, 50)
    assert best >= max(likelihood.log_likelihood(y, [a], [b]) for a in grid for b in grid) - 0.01
    near = [(ar[0] + da, ma[0] + db) for da in (-1e-4, 0, 1e-4) for db in (-1e-4, 0, 1e-4)]
    assert best >= max(likelihood.log_likelihood(y, [a], [b]) for a, b in near if abs(a) < 1 and abs(b) < 1) - 1e-9


def test_first_order_estimate_is_the_root_of_its_cubic():
    y = simulated([0.5], [], 30, 9)
    ((phi,), _, settled) = likelihood.fit(y, 1, 0, False)
    a, b, c = y @ y, y[1:] @ y[:-1], y[1:-1] @ y[1:-1]
    assert settled and len(y) * (b - c * phi) * (1 - phi**2) - phi * (a - 2 * b * phi + c * phi**2) == pytest.approx(0, abs=1e-7)


@pytest.mark.parametrize("order", [(1, 1, 1), (0, 1, 0), (2, 1, 0), (0, 0, 1), (3, 2, 2), (0, 0, 0), (1, 0, 0)])
@pytest.mark.parametrize("n", [3, 6, 30])
def test_every_order_gives_a_path_or_an_error(order, n):
    y = np.random.default_rng(n).normal(100, 10, n)
    if n < months_needed(order):
        with pytest.raises(ValueError, match="can't carry"):
            likelihood.likelihood_path(y, order, 6)
        return
    path, fitted = likelihood.likelihood_path(y, order, 6)
    assert len(path) == 6 and np.isfinite(path).all() and fitted.startswith("arima({},{},{})".format(*order))


def test_forecast_of_an_autoregression_with_a_mean():
    y = simulated([0.7], [], 200, 1) + 50
    path, _ = likelihood.likelihood_path(y, (1, 0, 0), 3)
    (phi,), _, _ = likelihood.fit(y, 1, 0, True)
    mean = likelihood._parts(list(y), [phi], [], True)[1]
    assert path == pytest.approx([mean + phi**k * (y[-1] - mean) for k in (1, 2, 3)])


@pytest.mark.parametrize("y", [np.arange(12.0), np.full(12, 4.0)])
def test_series_without_errors_go_on(y):
    assert likelihood.likelihood_path(y, (1, 1, 1), 2)[0] == pytest.approx(arima_path(y, (1, 1, 1), 2)[0])


# ---- trends that bend


def bent(n, bends, noise=0.0, seed=0, waves=False):
    m = np.arange(24000, 24000 + n)
    y = 100 + 2.0 * (m - m[0])
    for at, change in bends:
        y = y + change * np.maximum(m - m[0] - at, 0)
    if waves:
        y = y + 30 * np.cos(2 * np.pi * m / 12)
    return m, y + np.random.default_rng(seed).normal(0, noise, n) if noise else y


@pytest.mark.parametrize("waves", [False, True])
def test_planted_bends_are_recovered(waves):
    m, y = bent(96, [(40, 8.0)], 2.0, 3, waves)
    found = trend.fit(m, y, 3 if waves else 0)
    biggest = found["months"][abs(found["change"]).argmax()] - m[0]
    assert abs(biggest - 40) <= 4
    total = found["change"].sum() * found["scale"] / found["span"]
    assert total == pytest.approx(8.0, abs=0.5)
    ahead, told = trend.trend_path(m, y, 6, 3 if waves else 0)
    slope = np.diff(ahead).mean() if not waves else None
    assert ", bends " in told and (slope is None or slope == pytest.approx(10, abs=0.5))


def test_straight_lines_do_not_bend():
    m, y = bent(60, [])
    assert trend.trend_path(m, y, 3, 0) == (pytest.approx([220, 222, 224]), "trend, 0 waves")


@pytest.mark.parametrize("seed", range(5))
def test_conditions_of_the_optimum(seed):
    m, y = bent(80, [(20, 5.0), (50, -9.0)], 15.0, seed)
    found = trend.fit(m, y, 3)
    left, weight, change = found["pull"] - found["gram"] @ found["change"], found["weight"], found["change"]
    on = change != 0
    assert on.any() and np.allclose(left[on], weight * np.sign(change[on]), atol=1e-8 * weight + 1e-12)
    assert (abs(left[~on]) <= weight * (1 + 1e-8) + 1e-12).all()


def test_noise_is_at_rest():
    m, y = bent(80, [(30, 6.0)], 10.0, 2)
    found = trend.fit(m, y, 0)
    value, at = y / found["scale"], (m - m[0]) / found["span"]
    fitted = np.column_stack([np.ones(80), at]) @ found["weights"] + np.maximum(at[:, None] - found["places"], 0) @ found["change"]
    squares, s2 = ((value - fitted) ** 2).sum(), found["noise"]
    assert 80 / s2 - squares / s2**2 + 1 / trend.NOISE**2 == pytest.approx(0, abs=1e-3 * 80 / s2)


def test_a_tiny_prior_leaves_the_line():
    m, y = bent(48, [(20, 6.0)], 3.0)
    assert trend.trend_path(m, y, 6, 0, prior=1e-12)[0] == pytest.approx(seasonal_path(m, y, 6, 0)[0])
    assert trend.trend_path(m, y, 6, 3, changepoints=0)[0] == pytest.approx(seasonal_path(m, y, 6, 3)[0])


def test_places_lie_in_the_first_four_fifths():
    for n in (1, 2, 3, 5, 12, 24, 60, 200):
        places = trend.bend_places(n, 2, 25)
        assert len(places) <= min(25, max(0, n // 2)) and (places < max(1, 0.8 * n)).all() and (places > 0).all()
    assert len(trend.bend_places(200, 2, 25)) == 25


def test_constant_and_zero_series():
    m = np.arange(24000, 24030)
    for level in (0.0, 7.0):
        path, told = trend.trend_path(m, np.full(30, level), 2)
        assert path == pytest.approx([level, level], abs=1e-9) and "bends" not in told
