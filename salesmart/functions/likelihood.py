"""ARIMA of one monthly series by exact Gaussian likelihood, run inside grouped tasks.

The differenced series is an ARMA process in state-space form. A Kalman filter that begins with the
stationary distribution gives its likelihood, free of mean and variance, which have closed
forms; the search is over partial autocorrelations, so every trial is stationary and invertible.
"""

from __future__ import annotations

import cmath
import math
from itertools import product

import numpy as np

from salesmart.functions.series import arima_path, fit_arma, months_needed

ROUNDS = 100
STEP = 1e-30  # of the imaginary axis: derivatives without cancellation
REST, ROUGH = 1e-10, 0.1  # largest derivative of a search at rest, and of one that only compares hills
GRID = (-0.95, -0.4, 0.4, 0.95)  # partial autocorrelations to begin with, beside the conditional fit
HILLS = 3  # beginnings, the likeliest of all, that are searched from
EXACT = 1e-20  # share of a series' squares below which errors count as none


def _recursion(partial: list) -> list:
    """Coefficients of a stationary autoregression from its partial autocorrelations."""
    out: list = []
    for k, r in enumerate(partial):
        out = [out[i] - r * out[k - 1 - i] for i in range(k)] + [r]
    return out


def _partial(coefficients: np.ndarray) -> list[float]:
    """The inverse of ``_recursion``, kept inside the unit circle."""
    left, out = list(map(float, coefficients)), []
    while left:
        r = max(-0.97, min(0.97, left[-1]))
        out.append(r)
        rest = left[:-1]
        left = [(c + r * d) / (1 - r * r) for c, d in zip(rest, reversed(rest))]
    return out[::-1]


def _split(point: list, p: int) -> tuple[list, list]:
    """Autoregressive and moving-average coefficients of a point of the search."""
    bounded = [x / (1 + x * x) ** 0.5 for x in point]
    return _recursion(bounded[:p]), [-c for c in _recursion(bounded[p:])]


def _filter_two(series: list[list[float]], a: float, b: float, c: float) -> tuple[list[list], list, list[list]]:
    """``_filter`` for states of two numbers, written out: coefficients a and b, moving average c."""
    own = (1 + c * c + 2 * a * c + 2 * a * b * c / (1 - b)) / (1 - a * a - b * b - 2 * a * a * b / (1 - b))
    cross, other = b * (a * own + c) / (1 - b) + c, b * b * own + c * c
    gains, variances = [], []
    for _ in range(len(series[0])):
        first, second = (a * own + cross) / own, b
        gains.append((first, second))
        variances.append(own)
        own, cross, other = (
            a * a * own + 2 * a * cross + other + 1 - first * first * own,
            a * b * own + b * cross + c - first * second * own,
            b * b * own + c * c - second * second * own,
        )
    errors, states = [], []
    for values in series:
        x, z, found = 0.0, 0.0, []
        for value, (first, second) in zip(values, gains):
            v = value - x
            found.append(v)
            x, z = a * x + z + first * v, b * x + second * v
        errors.append(found)
        states.append([x, z])
    return errors, variances, states


def _filter(series: list[list[float]], ar: list, ma: list) -> tuple[list[list], list, list[list]]:
    """One-step errors of each series, their relative variances, and each series' last predicted state."""
    r = max(len(ar), len(ma) + 1)
    if r <= 2:
        return _filter_two(series, *[*ar, 0.0, 0.0][:2], *[*ma, 0.0][:1])
    phi, noise = [*ar, *[0.0] * (r - len(ar))], [1.0, *ma, *[0.0] * (r - 1 - len(ma))]
    move = np.zeros((r, r), complex if any(isinstance(c, complex) for c in (*ar, *ma)) else float)
    move[:, 0] = phi
    move[np.arange(r - 1), np.arange(1, r)] = 1
    added = np.outer(noise, noise)
    spread = np.linalg.solve(np.eye(r * r) - np.kron(move, move), added.ravel()).reshape(r, r).tolist()
    added, states = added.tolist(), [[0.0] * r for _ in series]
    errors: list[list] = [[] for _ in series]
    variances: list = []
    places = range(r)
    gain, settled = [0.0] * r, False
    for t in range(len(series[0])):
        f = spread[0][0]
        if not settled:
            gain = [(phi[i] * f + (spread[i + 1][0] if i + 1 < r else 0.0)) / f for i in places]
        for a, e, values in zip(states, errors, series):
            v = values[t] - a[0]
            first = a[0]
            for i in places:
                a[i] = phi[i] * first + (a[i + 1] if i + 1 < r else 0.0) + gain[i] * v
            e.append(v)
        variances.append(f)
        if settled:
            continue
        top = [*spread[0][1:], 0.0]
        new = [
            [
                phi[i] * phi[j] * f + phi[i] * top[j] + phi[j] * top[i] + (spread[i + 1][j + 1] if i + 1 < r and j + 1 < r else 0.0) + added[i][j] - gain[i] * gain[j] * f
                for j in places
            ]
            for i in places
        ]
        settled = new == spread
        spread = new
    return errors, variances, states


def _parts(y: list[float], ar: list, ma: list, with_mean: bool) -> tuple:
    """Half of minus twice the log-likelihood without its constant, the mean, and the last state."""
    errors, variances, states = _filter([y, [1.0] * len(y)] if with_mean else [y], ar, ma)
    own, mean, state = errors[0], 0.0, states[0]
    if with_mean:
        mean = sum(u * v / f for u, v, f in zip(errors[1], own, variances)) / sum(u * u / f for u, f in zip(errors[1], variances))
        own = [v - mean * u for u, v in zip(errors[1], own)]
        state = [a - mean * b for a, b in zip(state, states[1])]
    n, squares = len(y), sum(v * v / f for v, f in zip(own, variances))
    return (n * cmath.log(squares / n) + _log_product(variances)) / 2, mean, state


def _log_product(values: list) -> complex:
    """The sum of logarithms, sixteen factors at a time."""
    return sum(cmath.log(math.prod(values[i : i + 16])) for i in range(0, len(values), 16))


def log_likelihood(y: np.ndarray, ar: list[float], ma: list[float], with_mean: bool = False) -> float:
    """Exact Gaussian log-likelihood of an ARMA process; variance and mean, if any, are its maximum's."""
    return -_parts(list(map(float, y)), list(ar), list(ma), with_mean)[0].real - len(y) / 2 * (1 + math.log(2 * math.pi))


def fit(y: np.ndarray, p: int, q: int, with_mean: bool) -> tuple[list[float], list[float], bool]:
    """Coefficients of the largest likelihood, and whether the search came to rest."""
    values = list(map(float, y))

    def cost(point: list) -> complex:
        return _parts(values, *_split(point, p), with_mean)[0]

    def slope(point: np.ndarray) -> np.ndarray:
        out = []
        for k in range(p + q):
            moved = [complex(x, STEP if i == k else 0.0) for i, x in enumerate(point)]
            out.append(cost(moved).imag / STEP)
        return np.array(out)

    def climb(now: np.ndarray, rest: float) -> tuple[float, float, np.ndarray]:
        height, grade, curve = cost(list(now)).real, slope(now), np.eye(p + q)
        for _ in range(ROUNDS):
            if abs(grade).max() < rest:
                break
            way = -curve @ grade
            if way @ grade >= 0:
                curve, way = np.eye(p + q), -grade
            way *= min(1.0, 4.0 / abs(way).max())
            share = 1.0
            while share > 1e-6:
                new = now + share * way
                found = cost(list(new)).real
                if found <= height + 1e-4 * share * (way @ grade):
                    break
                # where heights differ by rounding alone, a smaller slope is progress
                if share > 0.1 and abs(found - height) <= 1e-11 * max(1.0, abs(height)) and abs(slope(new)).max() < abs(grade).max():
                    break
                share /= 2
            else:
                break  # no step helps
            after = slope(new)
            moved, turned = new - now, after - grade
            if moved @ turned > 1e-14:
                rho = 1 / (moved @ turned)
                left = np.eye(p + q) - rho * np.outer(moved, turned)
                curve = left @ curve @ left.T + rho * np.outer(moved, moved)
            now, height, grade = new, found, after
        return height, abs(grade).max(), now

    ar, ma, _, _ = fit_arma(y - y.mean() if with_mean else y, p, q)
    few = product(GRID, repeat=p + q) if p + q <= 2 else ([g] * (p + q) for g in GRID)
    starts = [np.array([r / math.sqrt(1 - r * r) for r in guess]) for guess in ([*_partial(ar), *_partial(-ma)], *few)]
    starts.sort(key=lambda x: cost(list(x)).real)
    _, _, now = min((climb(x, ROUGH) for x in starts[:HILLS]), key=lambda found: found[0])
    _, grade, now = climb(now, REST)
    ar, ma = _split(list(map(float, now)), p)
    return ar, ma, bool(grade < 1e-5)


def likelihood_path(y: np.ndarray, order: tuple[int, int, int], steps: int) -> tuple[np.ndarray, str]:
    """The next ``steps`` values by the most likely model, and what was fitted.

    A mean is fitted only without differencing. A series that follows its recursion without
    any error has no largest likelihood; it is continued by that recursion.
    """
    p, d, q = order
    if len(y) < months_needed(order):
        raise ValueError(f"{len(y)} values can't carry the order {order}")
    ends, x = [], y
    for _ in range(d):
        ends.append(x[-1])
        x = np.diff(x)
    centred = x - x.mean() if not d else x
    errors = fit_arma(centred, p, q)[2]
    if p + q == 0 or errors @ errors <= EXACT * max(x @ x, 1e-300):
        return arima_path(y, order, steps)
    ar, ma, settled = fit(x, p, q, not d)
    _, mean, state = _parts(list(map(float, x)), ar, ma, not d)
    r = len(state)
    phi = [*ar, *[0.0] * (r - len(ar))]
    path = []
    for _ in range(steps):
        path.append(state[0] + mean)
        state = [phi[i] * state[0] + (state[i + 1] if i + 1 < r else 0.0) for i in range(r)]
    out = np.array(path)
    for end in reversed(ends):
        out = end + np.cumsum(out)
    return out, f"arima({p},{d},{q})" + ("" if settled else ", not converged")
