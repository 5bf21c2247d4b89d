"""Runs of windows that share their smallest gram.

Two equal windows have the same smallest gram, wherever they stand. So windows that share
it are handled together, and a window whose smallest gram stands nowhere else is not
repeated. Windows of one text that follow each other and share it make one segment.
"""

from __future__ import annotations

import numpy as np

from salesmart.llm.words import mix

PLACE_BITS = 22


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    out, done = values, 1
    while 2 * done <= size:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[: len(values) - size + 1], out[size - done :]) if size > done else out


def segments(grams: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts that stand one after the other: place, number of windows, key, times.

    ``grams[i]`` is the hash of the ``gram`` symbols from ``i`` on; ``lengths`` are the texts'
    numbers of symbols. ``times`` tells how often the smallest gram stands in the segment. A
    segment has at most as many windows as a gram fits into, which bounds its length.
    """
    span = window - gram + 1
    total = int(lengths.sum())
    none = np.zeros(0, "i8")
    if total < window:
        return none, none, none.astype("u8"), none
    if total >= 1 << PLACE_BITS:
        raise ValueError("too many symbols at once")
    high = np.uint64(2**64 - 2**PLACE_BITS)
    order = (mix(grams) & high) | np.arange(len(grams), dtype="u8")
    least = _sliding_least(order, span)  # ties go to the first place
    place = (least & ~high).astype("i8")
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths)[: len(least)] - np.arange(len(least))
    inside = np.flatnonzero(left >= window)
    if not len(inside):
        return none, none, none.astype("u8"), none
    key = grams[place[inside]]
    new = np.r_[True, (key[1:] != key[:-1]) | (inside[1:] != inside[:-1] + 1)]
    begins = np.flatnonzero(new)
    size = np.diff(np.r_[begins, len(inside)])
    moved = np.r_[0, (place[inside[1:]] != place[inside[:-1]])].astype("i8")
    moved[begins] = 1
    if (size > span).any():  # only where a gram stands more than once
        parts = -(-size // span)
        owner = np.repeat(np.arange(len(begins)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        begins, size = begins[owner] + nth * span, np.minimum(span, size[owner] - nth * span)
    times = np.maximum(np.add.reduceat(moved, begins), 1)
    return inside[begins], size, key[begins], times
