from __future__ import annotations

import random

import numpy as np
import pytest
from llm_helpers import documents, near_duplicates, prose

from salesmart.llm import minhash


def edited(text: str, seed: int, edits: int) -> str:
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
    return " ".join(words)


def corpus() -> list:
    """Groups of edited copies whose similarities lie on both sides of the threshold."""
    rows, number = [], 0
    for group in range(12):
        base = prose(group, 60 + 25 * group)
        for copy in range(8):
            rows.append((1000 - number, edited(base, 50 * group + copy, copy * (2 + group // 4))))
            number += 1
    return rows


def found(docs, **more) -> dict:
    rows = minhash.near_duplicates(docs, **more).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize("block", [2048, 2])
def test_same_components_as_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    expected = near_duplicates(rows)
    assert len({c for _, c in expected.values()}) > 20
    assert found(documents(spark, rows)) == expected


def test_edge_rows(spark):
    base = prose(3, 40)
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo "), (6, "one two three"), (7, base), (8, base.upper()), (9, base + " end"),
        (10, prose(4, 30_000)), (11, prose(4, 30_000) + " end"), (12, "É" + base), (13, "é" + base), (14, "one two"),
    ]
    docs = documents(spark, rows)
    expected = near_duplicates(rows)
    assert expected[5] == (1, 4) and expected[8] == (expected[7][0], 7) and expected[14][1] == 14
    assert found(docs) == expected
    clash = docs.union(docs).withColumnRenamed("source", "kept").withColumnRenamed("lang", "component_id")
    assert minhash.near_duplicates(clash).count() == 2 * len(rows) and found(clash) == expected
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    (row,) = minhash.near_duplicates(documents(spark, [(None, base)])).collect()
    assert (row.doc_id, row.component_id, row.kept) == (None, None, None)


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(1)
    common, a, b = (np.unique(rng.integers(0, 2**63, n, dtype="u8")) for n in (800, 100, 100))
    one, two = (minhash.minima(np.r_[common, x], minhash._FINE) for x in (a, b))
    bits = [np.unpackbits(minhash.pack_bits(m, minhash.FINE_BITS).view("u1"), bitorder="little").reshape(-1, 2) for m in (one, two)]
    share = (bits[0] == bits[1]).all(axis=1).mean()
    assert abs((share - 0.25) / 0.75 - 0.8) < 0.05
    assert minhash.least_matches(75, minhash.FINE, minhash.FINE_BITS) < share * minhash.FINE
