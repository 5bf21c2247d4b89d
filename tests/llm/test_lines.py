"""Line deduplication against a dictionary of lines, and the perfect hash alone."""

from __future__ import annotations

import numpy as np
from llm_helpers import documents, prose
from pyspark.sql import functions as F

from salesmart.llm import lines

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def by_hand(rows):
    first: dict = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), d), d)
    out = []
    for d, t in rows:
        all_ = (t or "").split("\n")
        left = [x for x in all_ if d is None or len(key(x)) < 10 or first[key(x)] == d]
        out.append((d, "\n".join(left), len(all_), len(all_) - len(left)))
    return sorted(out, key=repr)


def found(docs):
    return sorted(map(tuple, lines.drop_repeated_lines(docs).select("doc_id", "kept", "n_lines", "n_dropped").collect()), key=repr)


ROWS = [
    (5, "A line that many have\nown line of five\n a LINE that many have\t\n\n"),
    (3, "a line that many have\na line that many have\nown line of three"),
    (9, "A LINE THAT MANY HAVE"),
    (1, None),
    (2, ""),
    (4, "short\nshort\n\n"),
    (6, "short\nÄäääääääää\nÀäääääääää\n0123456789\n012345678"),
    (7, "ääääääääää\nÄäääääääää\n\r0123456789\x0b\n012345678\r\n\x85a line that many have "),
    (None, "a line that many have"),
    (8, "own line of eight\nown line of eight"),
    (8, "own line of eight\nown line of eight"),
    (8, "a second text of number eight"),
    (11, "a second text of number eight"),
]


def test_edge_rows(spark):
    assert found(documents(spark, ROWS)) == by_hand(ROWS)


def test_empty_table_and_clashing_names(spark):
    assert found(documents(spark, [])) == []
    more = ", kept int, n_lines string, shard int, doc int, a string, first int"
    rows = spark.createDataFrame([(d, t, "en", "s", 1, 1, "x", 2, 3, "y", 4) for d, t in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint" + more)
    assert found(rows) == by_hand(ROWS)


def test_hot_line_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD", 64)
    rows = [(d, f"the one line that all have\n{prose(d, 12)}\n{prose(d % 7, 12)}") for d in range(600)]
    docs = documents(spark, rows)
    hashed = lines._hashed(docs, "doc_id", "text")
    arrays, shards = lines.build(hashed)
    assert shards > 5
    arrays = arrays.withColumn("pieces", F.when(F.col("pieces") >= 0, 4)).cache()
    probes, copies = lines._spread(hashed, arrays, shards)
    assert probes.select("shard", "piece").distinct().count() > shards
    assert found(docs) == by_hand(rows)


def test_very_long_text(spark):
    text = "\n".join(f"line number {i} of many" for i in range(200_000))
    rows = [(1, text), (2, text + "\nand one more line"), (3, "x" * 3_000_000)]
    assert found(documents(spark, rows)) == by_hand(rows)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 70_000):
        a, b = rng.integers(0, 2**64, (2, n), dtype="u8")
        levels = lines.perfect_hash(a, b)
        assert sorted(lines.indexes(levels, a, b).tolist()) == list(range(n))
        assert sum(map(len, levels)) < 8 * n + 1


def test_one_half_of_a_hash_may_agree():
    b = np.arange(500, dtype="u8")
    levels = lines.perfect_hash(np.zeros(500, "u8"), b)
    assert sorted(lines.indexes(levels, np.zeros(500, "u8"), b).tolist()) == list(range(500))


def test_arrays_answer_counts_and_know_strangers(spark):
    rows = [(d, "\n".join(prose(100 * (d if k > 2 else 0) + k, 9) for k in range(6))) for d in range(40)]
    arrays, shards = lines.build(lines._hashed(documents(spark, rows), "doc_id", "text"))
    assert shards == 1
    shard = lines.Shard(arrays.first().asDict())
    pairs = np.frombuffer(b"".join(h for _, t in rows for h in lines.line_hashes(t.encode())), "u8").reshape(-1, 2)
    count, first = shard.probe(pairs[:, 0], pairs[:, 1])
    assert sorted(set(count.tolist())) == [1, 40] and set(first.tolist()) == {0}
    strange = np.random.default_rng(5).integers(0, 2**64, (2, 1000), dtype="u8")
    assert not shard.probe(*strange)[0].any()
