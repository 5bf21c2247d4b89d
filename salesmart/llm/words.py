"""Hashes of words and of runs of words, for whole arrays of text.

A word is a run of bytes other than space, tab and the line breaks 0x0A to 0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLOCK = 1 << 20  # bytes hashed at once

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20).integers(0, 2**64, 256, dtype="u8")
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, base, "u8")
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        have = _powers[0] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Rolling sums: any run's hash is ``(sums[end] - sums[start]) * inverse[start]``."""
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(_BYTES[data] * powers(len(data))[0], out=sums[1:])
    return sums


def _hash_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte's place of each word of a block."""
    data = np.frombuffer(block, "u1")
    word = ~_WHITE[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    sums = prefix_sums(data)
    own = (sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts]
    return mix(own + (ends - starts).astype("u8")), starts


def _blocks(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        end = min(len(text), start + BLOCK)
        while end < len(text) and not _WHITE[text[end]]:
            end += 1
        yield text[start:end]
        start = end


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), "i8")
    i = 0
    while i < len(texts):
        if len(texts[i]) >= BLOCK:
            for block in _blocks(texts[i]):
                own, _ = _hash_block(block)
                hashes.append(own)
                counts[i] += len(own)
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and len(texts[j]) < BLOCK and size + len(texts[j]) < 2 * BLOCK:
            size += len(texts[j]) + 1
            j += 1
        own, starts = _hash_block(b"\n".join(texts[i:j]))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
        counts[i:j] = np.diff(np.searchsorted(starts, begins))
        hashes.append(own)
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, "u8")), counts


_RUN = np.random.default_rng(21).integers(0, 2**63, 64, dtype="u8") * np.uint64(2) + np.uint64(1)


def hash_runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; the order of words counts."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, size, "u8")
    for k in range(size):
        out += words[k : k + n] * _RUN[k]
    return mix(out)
