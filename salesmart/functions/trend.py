"""A trend that may bend, with yearly waves, for one monthly series, run inside grouped tasks.

The line's slope may change at up to 25 places in the first four fifths of the months. Changes
have a Laplace prior, so most are exactly zero; line and waves have flat ones. The point
estimate minimises errors and changes together, with the noise estimated beside them.
"""

from __future__ import annotations

import numpy as np

PLACES = 25
PART = 0.8  # of the months may hold bends
PRIOR = 0.05  # scale of the changes' prior, in units of the largest value per whole span
NOISE = 0.5  # scale of the half-normal prior of the noise
SWEEPS = 2000
ROUNDS = 50
FLOOR = 1e-6  # least noise, as a share of the spread
EXACT = 1e-20  # share of the squares below which line and waves leave nothing


def shrink(gram: np.ndarray, pull: np.ndarray, weight: float, start: np.ndarray) -> np.ndarray:
    """The d that minimises d'Gd / 2 - c'd + weight * |d|, by coordinate descent.

    Where the signs stand, the remaining equations are solved at once and kept if all
    conditions of the optimum hold.
    """
    d, scale = start.copy(), np.diag(gram)
    for sweep in range(SWEEPS):
        for j in np.flatnonzero(scale > 1e-14):
            rest = pull[j] - gram[j] @ d + scale[j] * d[j]
            d[j] = np.sign(rest) * max(abs(rest) - weight, 0.0) / scale[j]
        on = np.flatnonzero(d)
        exact = np.zeros(len(d))
        if len(on):
            exact[on] = np.linalg.lstsq(gram[np.ix_(on, on)], pull[on] - weight * np.sign(d[on]), rcond=None)[0]
        slack = 1e-9 * max(weight, abs(pull).max(initial=0.0), 1e-300)
        kept = (np.sign(exact[on]) == np.sign(d[on])).all()
        left = pull - gram @ exact
        if kept and (abs(left[on] - weight * np.sign(exact[on])) <= slack).all() and (abs(np.delete(left, on)) <= weight + slack).all():
            return exact
    return d


def bend_places(n: int, base: int, most: int) -> np.ndarray:
    """Which of ``n`` months may hold a bend: evenly spread, one for two values more than ``base`` at most."""
    reach = int(n * PART)
    count = max(0, min(most, reach - 1, (n - base) // 2))
    return np.unique(np.linspace(0, reach - 1, count + 1).round().astype(int)[1:]) if count else np.zeros(0, int)


def fit(months: np.ndarray, y: np.ndarray, waves: int, changepoints: int = PLACES, prior: float = PRIOR) -> dict:
    """The fitted parts of ``trend_path``: origin, span, scale, bends, their changes, weights, noise, penalty."""
    span = float(max(months[-1] - months[0], 1))
    scale = float(abs(y).max()) or 1.0
    at, value = (months - months[0]) / span, y / scale
    bends = bend_places(len(y), 2 + 2 * waves, changepoints)
    places = at[bends]
    smooth = _smooth(months, months[0], span, waves)
    basis, _ = np.linalg.qr(smooth)
    bent = np.maximum(at[:, None] - places, 0)
    rest, across = value - basis @ (basis.T @ value), bent - basis @ (basis.T @ bent)
    gram, pull = across.T @ across, across.T @ rest
    n, spread = len(y), max(float(value.var()), 1e-30)
    change, weight = np.zeros(len(places)), 0.0
    squares = float(rest @ rest)
    noise = 0.0
    for _ in range(ROUNDS):
        # the noise that minimises n log s + squares / 2s² + s² / 2 NOISE², given the errors
        before, noise = noise, max((np.sqrt(n * n + 4 * squares / NOISE**2) - n) * NOISE**2 / 2, FLOOR * spread)
        weight = noise / prior
        if len(places) and squares > EXACT * float(value @ value):
            change = shrink(gram, pull, weight, change)
        squares = float(((rest - across @ change) ** 2).sum())
        if abs(noise - before) <= 1e-10 * noise:
            break
    weights = np.linalg.lstsq(smooth, value - bent @ change, rcond=None)[0]
    return {"origin": int(months[0]), "span": span, "scale": scale, "months": months[bends], "places": places, "change": change, "weights": weights, "noise": noise, "weight": weight, "gram": gram, "pull": pull}


def _smooth(months: np.ndarray, origin: int, span: float, waves: int) -> np.ndarray:
    columns = [np.ones(len(months)), (months - origin) / span]
    for k in range(1, waves + 1):
        angle = 2 * np.pi * k * months / 12
        columns += [np.cos(angle), np.sin(angle)]
    return np.column_stack(columns)


def trend_path(months: np.ndarray, y: np.ndarray, steps: int, harmonics: int = 3, changepoints: int = PLACES, prior: float = PRIOR) -> tuple[np.ndarray, str]:
    """The next ``steps`` values, and what was fitted, with the months of the bends.

    ``months`` are absolute month numbers (12 * year + month - 1). Waves need two years of data and two
    values more than twice their coefficients. After the last month the last slope goes on.
    """
    waves = harmonics if months[-1] - months[0] >= 23 and len(y) >= 2 + 4 * harmonics else 0
    found = fit(months, np.asarray(y, float), waves, changepoints, prior)
    ahead = months[-1] + np.arange(1, steps + 1)
    at = (ahead - found["origin"]) / found["span"]
    values = _smooth(ahead, found["origin"], found["span"], waves) @ found["weights"] + np.maximum(at[:, None] - found["places"], 0) @ found["change"]
    bends = [f"{m // 12}-{m % 12 + 1:02d}" for m, c in zip(found["months"], found["change"]) if c]
    return values * found["scale"], f"trend, {waves} waves" + (f", bends {' '.join(bends)}" if bends else "")
