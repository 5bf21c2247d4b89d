from __future__ import annotations

import math

import numpy as np
import pytest
from llm_helpers import Sets

from salesmart.llm import projections, topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, component_id int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)


def clusters(seed: int, sizes: list[int], spread: float, dims: int = 16) -> list:
    rng = np.random.default_rng(seed)
    rows = []
    for size in sizes:
        centre = rng.standard_normal(dims)
        rows += [(centre + spread * rng.standard_normal(dims)) * rng.uniform(0.5, 3) for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(3 * i + 1), [float(np.float32(x)) for x in rows[k]]) for i, k in enumerate(order)]


ODD = [
    (900, None), (901, [0.0] * 16), (902, [math.nan] + [1.0] * 15), (903, [math.inf] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]),
]


def linked(rows) -> dict:
    good = {i: np.array(v, "f8") for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    found, links = Sets([i for i, _ in rows]), dict.fromkeys([i for i, _ in rows], 0)
    for a, x in good.items():
        for b, y in good.items():
            if a < b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[a] += 1
                links[b] += 1
                found.join(a, b)
    return {i: (links[i], found.find(i)) for i, _ in rows}


@pytest.mark.parametrize(("window", "block"), [(32, 1024), (4, 8)])
def test_links_as_by_all_pairs(spark, monkeypatch, window, block):
    monkeypatch.setattr(projections, "BLOCK", block)
    rows = clusters(1, [1] * 60 + [2] * 10 + [5] * 6 + [70], 0.1) + clusters(2, [30], 0.0)[:20] + ODD
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    copies = [(1000 + k, rows[k % 3][1]) for k in range(50)]
    expected = linked(rows + copies)
    got = {r.vec_id: (r.n_links, r.component_id) for r in projections.near_duplicates(table(spark, rows + copies), window=window).collect()}
    assert sum(n for n, _ in expected.values()) > 4000
    missed = sum(expected[i] != got[i] for i in expected)
    assert set(got) == set(expected) and missed <= 0.01 * len(expected)
    assert all(got[i][0] <= expected[i][0] for i in expected)  # never a link below the threshold


def test_recall_on_the_whole_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.orderBy("vec_id").collect()
    units = np.array([r.embedding for r in rows], "f8")
    units /= np.linalg.norm(units, axis=1)[:, None]
    near = units @ units.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in projections.near_duplicates(vectors).collect()}
    n = np.array([got[r.vec_id] for r in rows])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.99 * near.sum()


@pytest.mark.parametrize("cheaper", [16, 0.01])
def test_recall_off_centre_with_a_hot_cluster(spark, monkeypatch, cheaper):
    monkeypatch.setattr(projections, "CHEAPER", cheaper)
    rng = np.random.default_rng(8)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    def at(centres, cosine):  # vectors at this cosine to their centres
        noise = rng.standard_normal(centres.shape)
        noise = unit(noise - (noise * centres).sum(axis=1, keepdims=True) * centres)
        return cosine * centres + math.sqrt(1 - cosine * cosine) * noise

    direction = unit(rng.standard_normal((1, 64)))
    rows = at(np.repeat(direction, 4000, axis=0), math.sqrt(0.7))
    hot = at(np.repeat(rows[:1], 2000, axis=0), math.sqrt(0.85))
    planted = at(np.concatenate([rows[1:301], hot[:300]]), 0.955)
    units = np.concatenate([rows, hot, planted])[rng.permutation(6600)].astype("f4")
    checked = units.astype("f8") / np.linalg.norm(units.astype("f8"), axis=1)[:, None]
    near = checked @ checked.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() >= 1200
    got = {r.vec_id: r.n_links for r in projections.near_duplicates(table(spark, [(i, v.tolist()) for i, v in enumerate(units)])).collect()}
    n = np.array([got[i] for i in range(len(units))])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.99 * near.sum()


def test_passes_grow_with_the_table():
    few, many = projections.passes_for(1000), projections.passes_for(10**9)
    assert 4 <= projections.passes_for(1) <= few < many < 200


def test_projection_edge_rows(spark):
    docs = table(spark, ODD + [(908, [2.0, 4.0]), (908, [2.0, 4.0]), (None, [2.0, 4.0])])
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in projections.near_duplicates(docs).collect()}
    assert {(900, 0, 900, True), (901, 0, 901, True), (905, 0, 905, True), (906, 3, 906, True), (907, 3, 906, False), (908, 3, 906, False)} <= got
    assert projections.near_duplicates(docs.where("false")).count() == 0


def best(rows, k: int = 5) -> set:
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, v in whole.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in whole.items() if c != q and len(w) == len(v))
            out |= {(q, n, c, -s) for n, (s, c) in enumerate(scores[:k], start=1)}
    return out


@pytest.mark.parametrize(("candidates", "queries"), [(8192, 64), (50, 3)])
def test_top_k_as_by_all_scores(spark, monkeypatch, candidates, queries):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rows = [(i, v) for i, (_, v) in enumerate(clusters(3, [1] * 300 + [40], 0.05))]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)] + [(50 * i, v) for i, (_, v) in enumerate(ODD, start=100)]
    vectors = topk.quantised(table(spark, rows), "vec_id", "embedding")
    found = topk.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == best(rows)
    assert len(found) == len(best(rows))


def test_top_k_edge_rows(spark):
    vectors = topk.quantised(table(spark, [(0, [1.0, 1.0]), (1, [0.5, -0.001]), (1, [0.5, -0.001]), (2, None), (None, [1.0, 1.0])]), "vec_id", "embedding")
    found = topk.top_k(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in found] == [(1, 1, 128 * 256 - 256), (2, 1, 128 * 256 - 256)]
    assert topk.top_k(vectors.where("false"), vectors).count() == 0
    assert topk.top_k(vectors, vectors.where("false")).count() == 0
    with pytest.raises(Exception, match="too large"):
        huge = topk.quantised(table(spark, [(0, [1e9, 1.0]), (1, [1e9, 1.0])]), "vec_id", "embedding")
        topk.top_k(huge, huge).count()
