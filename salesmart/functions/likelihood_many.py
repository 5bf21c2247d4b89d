"""ARIMA by exact likelihood for many series of one length at once: the searches of ``likelihood``, step by step, on columns.

A column has one number per series, so a step of the filter is a few operations on arrays however many series there are.
Searches that have come to rest leave the arrays. Orders whose state is longer than two numbers, and series that are
constant, follow their recursion without error or lack a value, are fitted one by one.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np

from salesmart.functions import likelihood, series
from salesmart.functions.series import months_needed

CLOSE = 1e-14  # share of a series' squares below which errors are left to the single fit
ROWS = 2048  # series that are fitted side by side
AT_ONCE = 4096  # points that are tried side by side


# ---- conditional fits, where searches begin


def _tamed(coefficients: np.ndarray, limit: float) -> np.ndarray:
    if coefficients.shape[1] < 2:
        return np.clip(coefficients, -limit, limit)
    first, second = coefficients.T
    root = np.sqrt((first**2 + 4 * second).astype(complex))
    largest = np.maximum(abs(first + root), abs(first - root)) / 2
    shrink = np.where(largest <= limit + 1e-9, 1.0, limit / np.maximum(largest, 1e-300))
    return coefficients * shrink[:, None] ** np.arange(1, 3)


def _admissible(found: np.ndarray, p: int) -> np.ndarray:
    return np.hstack([_tamed(found[:, :p], 1.0), -_tamed(-found[:, p:], 0.99)])


def _residuals(x: np.ndarray, found: np.ndarray, p: int) -> np.ndarray:
    phi, theta = found[:, :p].T, found[:, p:].T
    errors = np.zeros_like(x)
    for t in range(max(len(phi), len(theta)), x.shape[1]):
        error = x[:, t].copy()
        for i, c in enumerate(phi, 1):
            error -= c * x[:, t - i]
        for i, c in enumerate(theta, 1):
            error -= c * errors[:, t - i]
        errors[:, t] = error
    return errors


def _lags(x: np.ndarray, count: int, start: int) -> np.ndarray:
    n = x.shape[1]
    return np.stack([x[:, start - i : n - i] for i in range(1, count + 1)], axis=2) if count else np.empty((len(x), n - start, 0))


def _least_squares(design: np.ndarray, y: np.ndarray) -> np.ndarray:
    inverse = np.linalg.pinv(design, rcond=np.finfo(float).eps * max(design.shape[1:]))
    return (inverse @ y[:, :, None])[:, :, 0]


def _first_guess(x: np.ndarray, p: int, q: int) -> np.ndarray:
    errors = np.zeros_like(x)
    if q:
        long = max(1, min(p + q + 1, x.shape[1] // 3))
        design = _lags(x, long, long)
        errors[:, long:] = x[:, long:] - (design @ _least_squares(design, x[:, long:])[:, :, None])[:, :, 0]
    start = max(p, q)
    return _least_squares(np.concatenate([_lags(x, p, start), _lags(errors, q, start)], axis=2), x[:, start:])


def fit_arma(x: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the least squared one-step errors, and those squares, for each row of ``x``."""
    best = _admissible(_first_guess(x, p, q), p)
    errors = _residuals(x, best, p)
    squares = (errors * errors).sum(axis=1)
    at = np.flatnonzero(squares > 0)
    for _ in range(series.PASSES):
        if not len(at):
            break
        here, begun = x[at], errors[at]
        slope = np.stack(
            [(_residuals(here, best[at] + shift, p) - begun) / series.NUDGE for shift in np.eye(p + q) * series.NUDGE], axis=2
        )
        step = _least_squares(slope, -begun)
        gain, left = np.full(len(at), -1.0), np.arange(len(at))
        for _ in range(series.HALVINGS):
            rows = at[left]
            trial = _admissible(best[rows] + step[left], p)
            found = _residuals(x[rows], trial, p)
            sums = (found * found).sum(axis=1)
            better = sums < squares[rows]
            gain[left[better]] = 1 - sums[better] / squares[rows[better]]
            best[rows[better]], errors[rows[better]], squares[rows[better]] = trial[better], found[better], sums[better]
            left = left[~better]
            if not len(left):
                break
            step[left] /= 2
        at = at[(gain >= 1e-10) & (squares[at] > 0)]
    return best, squares


# ---- the likelihood


def _coefficients(points: list, p: int) -> tuple[list, list]:
    bounded = [x / np.sqrt(1 + x * x) for x in points]
    return likelihood._recursion(bounded[:p]), [-c for c in likelihood._recursion(bounded[p:])]


def _parts(y: np.ndarray, ar: list, ma: list, with_mean: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """As ``likelihood._parts`` for each row of ``y``."""
    none = np.zeros(len(y))
    a, b, c = [*ar, none, none][0], [*ar, none, none][1], [*ma, none][0]
    own = (1 + c * c + 2 * a * c + 2 * a * b * c / (1 - b)) / (1 - a * a - b * b - 2 * a * a * b / (1 - b))
    cross, other = b * (a * own + c) / (1 - b) + c, b * b * own + c * c
    n = y.shape[1]
    values = [*y.T]
    tracks = [[none, none] for _ in range(1 + with_mean)]
    errors: list[list] = [[] for _ in tracks]
    variances, logs, factor = [], none, 1.0
    for t in range(n):
        first, second = (a * own + cross) / own, b
        for track, seen, value in zip(tracks, errors, (values[t], 1.0)):
            x, z = track
            v = value - x
            track[:] = a * x + z + first * v, b * x + second * v
            seen.append(v)
        variances.append(own)
        factor = factor * own
        if t % 16 == 15 or t == n - 1:
            logs, factor = logs + np.log(factor), 1.0
        own, cross, other = (
            a * a * own + 2 * a * cross + other + 1 - first * first * own,
            a * b * own + b * cross + c - first * second * own,
            b * b * own + c * c - second * second * own,
        )
    left, mean, state = errors[0], none, tracks[0]
    if with_mean:
        mean = sum(u * v / f for u, v, f in zip(errors[1], left, variances)) / sum(u * u / f for u, f in zip(errors[1], variances))
        left = [v - mean * u for u, v in zip(errors[1], left)]
        state = [s - mean * u for s, u in zip(*tracks)]
    squares = sum(v * v / f for v, f in zip(left, variances))
    return (n * np.log(squares / n) + logs) / 2, mean, state


def _cost(y: np.ndarray, points: np.ndarray, p: int, with_mean: bool) -> np.ndarray:
    """Real points, a row each, may be more than a pass takes."""
    out = np.empty(len(y))
    for at in range(0, len(y), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        out[some] = _parts(y[some], *_coefficients([*points[some].T], p), with_mean)[0]
    return out


def _slope(y: np.ndarray, points: np.ndarray, p: int, with_mean: bool) -> np.ndarray:
    out = np.empty(points.shape)
    for at in range(0, len(y), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        for k in range(points.shape[1]):
            moved = [x + 1j * (likelihood.STEP if i == k else 0.0) for i, x in enumerate(points[some].T)]
            out[some, k] = _parts(y[some], *_coefficients(moved, p), with_mean)[0].imag / likelihood.STEP
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1)


def _climb(y: np.ndarray, now: np.ndarray, p: int, with_mean: bool, rest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The search of ``likelihood.fit`` from each row of ``now``: heights, largest derivatives and points."""
    now, k = now.copy(), now.shape[1]
    height, grade = _cost(y, now, p, with_mean), _slope(y, now, p, with_mean)
    curve = np.tile(np.eye(k), (len(y), 1, 1))
    at = np.arange(len(y))
    for _ in range(likelihood.ROUNDS):
        at = at[~(abs(grade[at]).max(axis=1) < rest)]
        if not len(at):
            break
        way = -(curve[at] @ grade[at][:, :, None])[:, :, 0]
        up = _dot(way, grade[at]) >= 0
        curve[at[up]], way[up] = np.eye(k), -grade[at[up]]
        way *= np.minimum(1.0, 4.0 / abs(way).max(axis=1))[:, None]
        new, reached, after = now[at], height[at], np.empty((len(at), k))
        left, share = np.arange(len(at)), 1.0
        while share > 1e-6 and len(left):
            rows = at[left]
            trial = now[rows] + share * way[left]
            found = _cost(y[rows], trial, p, with_mean)
            fits = found <= height[rows] + 1e-4 * share * _dot(way[left], grade[rows])
            if share > 0.1:
                level = ~fits & (abs(found - height[rows]) <= 1e-11 * np.maximum(1.0, abs(height[rows])))
                if level.any():
                    flat = abs(_slope(y[rows[level]], trial[level], p, with_mean)).max(axis=1) < abs(grade[rows[level]]).max(axis=1)
                    fits[np.flatnonzero(level)[flat]] = True
            new[left[fits]], reached[left[fits]] = trial[fits], found[fits]
            left, share = left[~fits], share / 2
        moves = np.ones(len(at), bool)
        moves[left] = False  # no step helps
        at, new, reached = at[moves], new[moves], reached[moves]
        if not len(at):
            break
        after = _slope(y[at], new, p, with_mean)
        moved, turned = new - now[at], after - grade[at]
        firm = _dot(moved, turned) > 1e-14
        moved, turned, rows = moved[firm], turned[firm], at[firm]
        rho = 1 / _dot(moved, turned)[:, None, None]
        turn = np.eye(k) - rho * moved[:, :, None] * turned[:, None, :]
        curve[rows] = turn @ curve[rows] @ turn.transpose(0, 2, 1) + rho * moved[:, :, None] * moved[:, None, :]
        now[at], height[at], grade[at] = new, reached, after
    return height, abs(grade).max(axis=1), now


def _partial(coefficients: np.ndarray) -> np.ndarray:
    return np.array([likelihood._partial(row) for row in coefficients]).reshape(coefficients.shape)


def fit(y: np.ndarray, begin: np.ndarray, p: int, q: int, with_mean: bool) -> tuple[np.ndarray, np.ndarray]:
    """The point of the largest likelihood of each row, and whether its search came to rest; ``begin`` has the conditional fits."""
    rows, k = len(y), p + q
    few = [*product(likelihood.GRID, repeat=k)] if k <= 2 else [[g] * k for g in likelihood.GRID]
    guesses = [np.hstack([_partial(begin[:, :p]), _partial(-begin[:, p:])]), *(np.tile(np.array(g, float), (rows, 1)) for g in few)]
    starts = np.stack([g / np.sqrt(1 - g * g) for g in guesses], axis=1)
    heights = _cost(np.repeat(y, len(guesses), axis=0), starts.reshape(-1, k), p, with_mean).reshape(rows, -1)
    best = np.argsort(heights, axis=1, kind="stable")[:, : likelihood.HILLS]
    hills = np.take_along_axis(starts, best[:, :, None], axis=1)
    found, _, points = _climb(np.repeat(y, hills.shape[1], axis=0), hills.reshape(-1, k), p, with_mean, likelihood.ROUGH)
    found, points = found.reshape(rows, -1), points.reshape(hills.shape)
    now = points[np.arange(rows), found.argmin(axis=1)]
    _, grade, now = _climb(y, now, p, with_mean, likelihood.REST)
    return now, grade < 1e-5


def likelihood_paths(y: np.ndarray, order: tuple[int, int, int], steps: int) -> list[tuple[np.ndarray, str]]:
    """``likelihood.likelihood_path`` for each row of ``y``."""
    if len(y) > ROWS:
        return [found for at in range(0, len(y), ROWS) for found in likelihood_paths(y[at : at + ROWS], order, steps)]
    p, d, q = order
    out = [None] * len(y)
    if 0 < p + q and p <= 2 and q <= 1 and y.shape[1] >= months_needed(order):
        x, ends = y, []
        for _ in range(d):
            ends.append(x[:, -1])
            x = np.diff(x, axis=1)
        rows = np.flatnonzero(np.isfinite(x).all(axis=1) & (np.ptp(x, axis=1) > 0))
        with np.errstate(all="ignore"):
            regular = _regular_paths(x[rows], p, q, not d, steps)
        for row, found in zip(rows, regular):
            if found is not None and np.isfinite(path := found[0]).all():
                for end in reversed(ends):
                    path = end[row] + np.cumsum(path)
                out[row] = path, f"arima({p},{d},{q})" + ("" if found[1] else ", not converged")
    return [found if found is not None else likelihood.likelihood_path(row, order, steps) for found, row in zip(out, y)]


def _regular_paths(x: np.ndarray, p: int, q: int, with_mean: bool, steps: int) -> list[tuple[np.ndarray, bool] | None]:
    """Paths of the differenced series and whether their searches rest; None for those that a single fit must judge."""
    if not len(x):
        return []
    centred = x - x.mean(axis=1)[:, None] if with_mean else x
    try:
        begin, squares = fit_arma(centred, p, q)
        kept = np.flatnonzero(squares > CLOSE * np.maximum((x * x).sum(axis=1), 1e-300))
        if not len(kept):
            return [None] * len(x)
        points, rests = fit(x[kept], begin[kept], p, q, with_mean)
    except np.linalg.LinAlgError:
        return [None] * len(x)
    ar, ma = _coefficients([*points.T], p)
    _, mean, state = _parts(x[kept], ar, ma, with_mean)
    path = []
    for _ in range(steps):
        path.append(state[0] + mean)
        state = [sum(c * state[0] for c in ar[:1]) + state[1], ar[1] * state[0] if p > 1 else np.zeros(len(kept))]
    out: list = [None] * len(x)
    for row, values, rest in zip(kept, np.array(path).reshape(steps, len(kept)).T, rests):
        out[row] = values, bool(rest)
    return out
