"""Merkle trees against trees built by hand."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from salesmart.llm import manifest, ranks

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def by_hand(rows):
    """doc_id, leaf, subroot, root, proof, folded root of rows (doc_id, source, lang, n_chars, text)."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0], sha("".join(map(field, r)))))
        trees[s] = tree([sha("".join(map(field, r))) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = text.translate(str.maketrans(UPPER, LOWER))
            fold, proof = sha("".join(map(field, (*r[:4], text)))), ""
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run, j = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
                    proof += "".join(run[:j] + run[j + 1 :])
                    fold, at = sha("".join([*run[:j], fold, *run[j + 1 :]])), at // 16
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], sha(proof), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def audited(spark, rows, more=""):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string" + more)
    found = manifest.audit(docs, {"text": F.translate("text", UPPER, LOWER)}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return sorted(map(tuple, found.collect()), key=repr)


SIZES = {"one": 1, "run": 16, "over": 17, "ärger": 40, None: 3, "": 2, "large": 300}


def test_trees_by_hand(spark):
    rows = [(1000 * k + i, s, "en" if i % 3 else None, i, f"Text {i} Ä" if i % 4 else None) for k, (s, n) in enumerate(SIZES.items()) for i in range(n)]
    rows += [(7, "large", "en", 0, ""), (8, "large", None, None, "A" * 200_000)]
    assert audited(spark, rows) == by_hand(rows)


def test_many_groups_make_a_tree_of_their_own(spark):
    rows = [(i, f"s{i}", "en", 1, f"T{i}") for i in range(300)]
    assert audited(spark, rows) == by_hand(rows)


def test_one_leaf_is_the_root(spark):
    rows = [(5, "s", "en", 1, "T")]
    assert audited(spark, rows) == by_hand(rows)
    assert audited(spark, rows)[0][4] == sha("")


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "s", None, None, None), (None, None, None, None, None), *[(3, "s", "en", 1, "Abc")] * 20, (3, "s", "en", 1, "abc")]
    assert audited(spark, rows) == by_hand(rows)


def test_empty_table_and_clashing_names(spark):
    assert audited(spark, []) == []
    plain = [(i, "s", "en", 1, f"T{i}") for i in range(20)]
    more = ", leaf string, key string, root string, grp int, tree int"
    assert audited(spark, [(*r, "x", "y", "z", 1, 2) for r in plain], more) == by_hand(plain)


def test_a_changed_digest_is_found_where_it_is(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"t{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    found = manifest.audit(docs, {"n_chars": F.lit(2)}, F.col("doc_id") == 41)
    assert [r.doc_id for r in found.where("not verified").collect()] == [41]


def test_nodes_are_linked_to_their_parents(spark):
    leaves = spark.range(1000).select(F.col("id").alias("key"), F.lit("g").alias("grp"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(None).cast("string").alias("claim"))
    built = manifest.build(leaves)
    nodes = built.nodes.collect()
    assert len({n.node for n in nodes}) == len(nodes) == 63 + 4
    assert {n.parent for n in nodes} - {n.node for n in nodes} == {built.root_node}


def test_row_limit_is_put_back(spark):
    before = spark.conf.get(manifest.ROW_LIMIT)
    audited(spark, [(i, "s", "en", 1, "T") for i in range(20)])
    assert spark.conf.get(manifest.ROW_LIMIT) == before


@pytest.mark.parametrize("groups", [1, 7])
def test_ranks_of_a_hot_group_come_from_many_tasks(spark, groups):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % groups).alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    placed = ranks.ranked(rows, ["g"], ["v"]).collect()
    by: dict = {}
    for r in placed:
        by.setdefault(r.g, []).append((r["rank"], r.v, r.of))
    for own in by.values():
        own.sort()
        assert [r[0] for r in own] == list(range(len(own))) and {r[2] for r in own} == {len(own)}
        assert [r[1] for r in own] == sorted(r[1] for r in own)
