"""Small least-squares fits for one monthly series, run inside grouped tasks.

Estimates differ from those of maximum-likelihood packages; the model equations
are the same.
"""

from __future__ import annotations

import numpy as np

PASSES = 30
HALVINGS = 8
NUDGE = 1e-6


def _lags(x: np.ndarray, count: int, start: int) -> np.ndarray:
    """Columns x[t-1] … x[t-count] for t from ``start`` on."""
    lags = [x[start - i : len(x) - i] for i in range(1, count + 1)]
    return np.array(lags).T if lags else np.empty((len(x) - start, 0))


def _tamed(coefficients: np.ndarray, limit: float) -> np.ndarray:
    """Shrink a recursion whose largest root is beyond ``limit``."""
    if len(coefficients) < 2:
        return np.clip(coefficients, -limit, limit)
    largest = max(abs(np.roots(np.r_[1.0, -coefficients])), default=0.0)
    if largest <= limit + 1e-9:
        return coefficients
    return coefficients * (limit / largest) ** np.arange(1, len(coefficients) + 1)


def _residuals(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """One-step errors. The recursion is scalar, so plain floats beat small arrays."""
    values, phi, theta = x.tolist(), ar.tolist(), ma.tolist()
    errors = [0.0] * max(len(phi), len(theta))
    for t in range(len(errors), len(values)):
        error = values[t]
        for i, c in enumerate(phi, 1):
            error -= c * values[t - i]
        for i, c in enumerate(theta, 1):
            error -= c * errors[t - i]
        errors.append(error)
    return np.array(errors)


def _first_guess(x: np.ndarray, p: int, q: int) -> np.ndarray:
    """Regress the series on its own lags and on those of the errors that a longer
    autoregression leaves."""
    errors = np.zeros(len(x))
    if q:
        long = max(1, min(p + q + 1, len(x) // 3))
        design = _lags(x, long, long)
        errors[long:] = x[long:] - design @ np.linalg.lstsq(design, x[long:], rcond=None)[0]
    start = max(p, q)
    design = np.hstack([_lags(x, p, start), _lags(errors, q, start)])
    return np.linalg.lstsq(design, x[start:], rcond=None)[0]


def _admissible(found: np.ndarray, p: int) -> np.ndarray:
    """The nearest coefficients that neither explode nor forget how to invert."""
    return np.r_[_tamed(found[:p], 1.0), -_tamed(-found[p:], 0.99)]


def months_needed(order: tuple[int, int, int]) -> int:
    """The shortest series that can carry an order: one error more than coefficients after differencing."""
    p, d, q = order
    return d + (max(p, q) + p + q + 1 if p + q else 1)


def fit_arma(x: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """AR and MA coefficients that minimise the sum of squared one-step errors, with
    the errors before the first full set of lags taken as zero; those errors; and whether
    the search came to rest.

    Gauss-Newton from a regression guess, with shorter steps where a full one does
    not help. A series too short for the terms is an error.
    """
    if len(x) < months_needed((p, 0, q)):
        raise ValueError(f"{len(x)} values can't carry {p} autoregressive and {q} moving-average terms")
    if p + q == 0:
        return np.empty(0), np.empty(0), x.copy(), True

    def errors_of(found: np.ndarray) -> np.ndarray:
        return _residuals(x, found[:p], found[p:])

    best = _admissible(_first_guess(x, p, q), p)
    errors = errors_of(best)
    settled = False
    for _ in range(PASSES):
        if not errors @ errors:
            settled = True
            break
        shifts = np.eye(p + q) * NUDGE
        slope = np.array([(errors_of(best + shift) - errors) / NUDGE for shift in shifts]).T
        step = np.linalg.lstsq(slope, -errors, rcond=None)[0]
        for _ in range(HALVINGS):
            trial = _admissible(best + step, p)
            trial_errors = errors_of(trial)
            if trial_errors @ trial_errors < errors @ errors:
                break
            step = step / 2
        else:
            settled = True  # no step helps
            break
        gain = 1 - (trial_errors @ trial_errors) / (errors @ errors)
        best, errors = trial, trial_errors
        if gain < 1e-10:
            settled = True
            break
    return best[:p], best[p:], errors, settled


def arima_path(y: np.ndarray, order: tuple[int, int, int], steps: int) -> tuple[np.ndarray, str]:
    """The next ``steps`` values, and what was fitted; a mean is fitted only without differencing."""
    p, d, q = order
    if len(y) < months_needed(order):
        raise ValueError(f"{len(y)} values can't carry the order {order}")
    ends = []
    for _ in range(d):
        ends.append(y[-1])
        y = np.diff(y)
    mean = y.mean() if not ends else 0.0
    ar, ma, errors, settled = fit_arma(y - mean, p, q)
    x, e = list(y - mean), list(errors)
    for _ in range(steps):
        x.append(sum(c * x[-i] for i, c in enumerate(ar, 1)) + sum(c * e[-i] for i, c in enumerate(ma, 1)))
        e.append(0.0)
    path = np.array(x[len(x) - steps :]) + mean
    for end in reversed(ends):
        path = end + np.cumsum(path)
    return path, f"arima({p},{d},{q})" + ("" if settled else ", not converged")


def seasonal_path(months: np.ndarray, y: np.ndarray, steps: int, harmonics: int = 3) -> tuple[np.ndarray, str]:
    """Straight trend plus ``harmonics`` yearly waves, and what was fitted.

    ``months`` are absolute month numbers (12 * year + month - 1). Waves need two years of
    data and two values more than twice their coefficients; the text tells how many were
    fitted where a series has less.
    """
    waves = harmonics if months[-1] - months[0] >= 23 and len(y) >= 2 + 4 * harmonics else 0

    def design(at: np.ndarray) -> np.ndarray:
        angles = [2 * np.pi * k * at / 12 for k in range(1, waves + 1)]
        columns = [np.ones(len(at)), (at - months[0]) / 12.0]
        for angle in angles:
            columns += [np.cos(angle), np.sin(angle)]
        return np.column_stack(columns)

    weights = np.linalg.lstsq(design(months), y, rcond=None)[0]
    return design(months[-1] + np.arange(1, steps + 1)) @ weights, f"trend, {waves} waves"
