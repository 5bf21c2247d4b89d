"""Small tables and brute-force twins for the tests of this folder."""

from __future__ import annotations

import random
from collections import defaultdict

WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "ly", "ing"]) for _ in range(words))


def documents(spark, rows, more: str = ""):
    """Rows of number and text as a table like ``documents``, with columns that clash with results."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + more
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], schema)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


class Sets:
    """Smallest member of each joined set."""

    def __init__(self, nodes) -> None:
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_duplicates(rows) -> dict:
    """Shingles and component of each number, all pairs compared."""
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = {}
    for d, t in rows:
        w = (t or "").encode().translate(lower).split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    found = Sets(sets)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                found.join(a, b)
    return {d: (len(sets[d]), found.find(d)) for d in ids}


def repeated_words(rows, window: int = 50) -> dict:
    """Words left of each number, by all windows."""
    first: dict = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = b" ".join(x for x, g in zip(w, gone) if not g).decode()
    return out


def repeated_bytes(rows, window: int = 100) -> dict:
    """Bytes left of each number and the number of removed runs, by all windows."""
    places = defaultdict(list)
    for d, t in rows:
        data = (t or "").encode()
        for i in range(len(data) - window + 1):
            places[data[i : i + window]].append((d, i))
    out = {}
    first = {k: min(v) for k, v in places.items()}
    for d, t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - window + 1):
            if first[data[i : i + window]] < (d, i):
                gone[i : i + window] = [True] * window
        spans = sum(g and not p for p, g in zip([False, *gone], gone))
        out[d] = (bytes(b for b, g in zip(data, gone) if not g), spans)
    return out
