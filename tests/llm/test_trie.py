"""Prefix tries against tries built by hand."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from salesmart.llm import trie


def by_hand(rows):
    """The nodes of rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    members, children, parent, worth, ends = defaultdict(list), defaultdict(set), {}, {}, defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c - 20 * int(c / 20))  # the remainder has the sign of c
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            node = tuple(turns[:d])
            members[node].append(c)
            worth[node] = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if d else 0
            if d:
                parent[node] = node[:-1]
                children[node[:-1]].add(node)
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * worth[node]
        if node in parent:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    return sorted(
        (
            (m[0], len(n), members[parent[n]][0] if n in parent else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
            for n, m in members.items()
        ),
        key=repr,
    )


def found(spark, rows, more=""):
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string" + more)
    return sorted(map(tuple, trie.prefix_trie(*trie.rebuilt(trie.tokens(table))).collect()), key=repr)


@pytest.mark.parametrize("longest", [1, 2, 5, 21])
def test_random_conversations(spark, longest):
    rng = random.Random(longest)
    rows = []
    for c in range(0, 90):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a b", "a  b c", "", None, "d\te"])))
    assert found(spark, rows) == by_hand(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, None, "x y"), (1, 0, "user", None), (1, 0, "user", None), (2, 0, "user", "same"), (2, 0, "user", "same"), (None, 0, "user", "lost"), (20, 5, None, None)]
    assert found(spark, rows) == by_hand(rows)


def test_conversation_without_turns_ends_at_the_root(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "gone"), (40, 0, "user", "stays here")]
    nodes = found(spark, rows)
    assert nodes == by_hand(rows)
    assert (c, 0, None, 2, 1, 1, 0, hashlib.sha256(str(c).encode()).hexdigest()) in nodes


def test_conversations_that_all_begin_alike(spark):
    rows = [(c, t, "user", "hello" if t < 3 else f"turn {t} of {c % 5}") for c in range(300) for t in range(6)]
    assert found(spark, rows) == by_hand(rows)


def test_one_conversation_with_most_turns(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(700)] + [(7 + 20 * c, t, "user", f"turn {t}") for c in range(1, 6) for t in range(10 * c)]
    assert found(spark, rows) == by_hand(rows)


def test_very_long_text_empty_table_and_clashing_names(spark):
    assert found(spark, []) == []
    rows = [(40, 0, "user", "w " * 500_000), (60, 0, "user", "w " * 500_000)]
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, [(*r, 1, "x", 2, 3) for r in rows], ", depth int, name string, pos int, token int") == by_hand(rows)


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(40, 0, "us", "er"), (60, 0, "use", "r"), (80, 0, "", "user")]
    assert len(found(spark, rows)) == 4
