from __future__ import annotations

import numpy as np
import pytest
from llm_helpers import documents, prose, repeated_bytes, repeated_words

from salesmart.llm import pfp, repeats, substring
from salesmart.llm.anchors import segments
from salesmart.llm.words import hash_runs, hash_words


def passages() -> list:
    """Documents that share passages, whole copies, lines, and runs of one word or letter."""
    shared = [prose(900 + i, 50 + 13 * i) for i in range(5)]
    rows = []
    for i in range(40):
        parts = [prose(i, 30 + i)]
        parts += [shared[(i + k) % 5] for k in range(i % 3)]
        parts.append(prose(500 + i // 2, 45 + i))
        rows.append((200 - 3 * i, " ".join(parts)))
    rows += [(1, "x " * 130), (2, "x " * 49), (3, "x " * 51), (4, "a" * 350), (5, "b" + "a" * 99), (6, "ab" * 120 + "c" + "ab" * 120)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, rows[7][1][100:-100])]
    line = "".join(f"{i:04d} " for i in range(40))
    rows += [(310, line + "first\n" + line), (311, "é" * 70), (312, "zé" + "é" * 90)]
    return rows


EDGES = [(400, None), (401, ""), (402, " \n\t "), (403, prose(1, 20)), (404, prose(77, 3000)), (404, prose(77, 3000)), (405, prose(77, 3000)[300:]), (None, prose(77, 3000))]


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_words_as_by_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "LIMIT", 2000)  # long texts come in pieces
    rows = passages() + EDGES[:6]
    expected = repeated_words(rows)
    kept = substring.remove_repeats(documents(spark, rows)).collect()
    assert len(kept) == len(rows)
    for r in kept:
        assert (r.kept, r.n_words) == (expected[r.doc_id], len((r.text or "").split()))
        assert r.n_removed == r.n_words - len(r.kept.split())
    assert sum(r.n_removed for r in kept) > 1000


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_bytes_as_by_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "LIMIT", 4000)
    rows = passages() + EDGES[:5]
    expected = repeated_bytes(rows)
    kept = pfp.remove_repeats(documents(spark, rows)).collect()
    assert len(kept) == len(rows)
    for r in kept:
        data = (r.text or "").encode()
        assert (bytes(r.kept), r.n_spans, r.n_bytes, r.n_removed) == (*expected[r.doc_id], len(data), len(data) - len(r.kept))
    assert sum(r.n_removed for r in kept) > 5000


@pytest.mark.parametrize("operator", [substring.remove_repeats, pfp.remove_repeats])
def test_edge_rows(spark, operator):
    docs = documents(spark, EDGES).withColumnRenamed("source", "kept").withColumnRenamed("lang", "runs")
    rows = operator(docs).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r for r in rows}
    assert all(by[d].n_removed == 0 and not by[d].kept.strip() for d in (400, 401, 402))
    assert by[404].n_removed == 0 and by[None].n_removed == 0 and by[405].n_removed > 0
    assert operator(docs.where("false")).count() == 0


def test_white_space_can_stay(spark):
    rows = [(1, prose(5, 60)), (2, "Keep  this\n" + prose(5, 60) + "\nand\tthat ")]
    kept = {r.doc_id: r.kept for r in substring.remove_repeats(documents(spark, rows), spaced=True).collect()}
    assert kept == {1: rows[0][1], 2: "Keep  this\nand\tthat "}


def test_backward_search_counts_like_a_scan():
    rng = np.random.default_rng(4)
    text = np.concatenate([np.r_[rng.integers(1, 5, n), 0] for n in (150, 3, 90, 160)])  # 0 ends a segment
    index = substring.FMIndex(text, 6)
    for start in range(len(text)):
        for size in (1, 3, 6):
            pattern = text[start : start + size]
            if len(pattern) < size or (pattern == 0).any():
                continue
            low, high = np.array([0]), np.array([len(text)])
            for symbol in pattern[::-1]:
                low, high = index.extend(np.array([symbol]), low, high)
            expected = {i for i in range(len(text)) if np.array_equal(text[i : i + size], pattern)}
            assert set(index.order[low[0] : high[0]].tolist()) == expected
            if size == 6:
                assert [int(x[0]) for x in index.cap(low)] == [int(low[0]), int(high[0])]


def test_parsing_gives_the_order_of_suffixes():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.choice([97, 98, 99], n, p=[0.6, 0.3, 0.1]).astype("u1")) for n in (300, 120, 500, 140)]
    texts += [texts[0][50:250], b"a" * 200, b"ab" * 100]
    data = np.frombuffer(b"".join(texts), "u1")
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    places = np.arange(len(data))
    order = pfp.corpus_order(data, begins, ends, places)
    owner = np.repeat(np.arange(len(texts)), ends - begins)
    suffixes = [bytes(data[p : ends[owner[p]]]) for p in order]
    assert suffixes == sorted(suffixes)


@pytest.mark.parametrize("symbols", [1, 2, 40, 256])
def test_parsing_orders_some_places_alike(symbols):
    """Only asked places are ranked; how many symbols a number holds follows from the alphabet."""
    rng = np.random.default_rng(symbols)
    texts = [bytes(rng.integers(0, symbols, n).astype("u1")) for n in (400, 150, 260, 101)]
    texts += [texts[0][100:300] + texts[2][:120], texts[1], texts[0][:180]]
    data = np.frombuffer(b"".join(texts), "u1")
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    places = np.sort(rng.choice(len(data), len(data) // 3, replace=False))
    owner = np.repeat(np.arange(len(texts)), ends - begins)
    order = places[pfp.corpus_order(data, begins, ends, places)]
    suffixes = [bytes(data[p : ends[owner[p]]]) for p in order]
    assert sorted(order) == places.tolist() and suffixes == sorted(suffixes)


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(8)
    lengths = np.array([0, 49, 50, 400, 90, 300])
    words = rng.integers(1, 4, int(lengths.sum())).astype("u8")  # few words, many ties
    place, n, key, times = segments(hash_runs(words, 12), lengths, 50, 12)
    by_window: dict = {}
    seen = []
    for p, size, k in zip(place, n, key):
        for at in range(p, p + size):
            seen.append(int(at))
            by_window.setdefault(words[at : at + 50].tobytes(), set()).add(int(k))
    begins = np.cumsum(lengths) - lengths
    assert sorted(seen) == [b + i for b, size in zip(begins, lengths) for i in range(size - 49)]
    assert all(len(keys) == 1 for keys in by_window.values())
    assert (n <= 39).all() and (times >= 1).all()


def test_word_hashes_do_not_depend_on_blocks():
    texts = [b"", b" a  bc\td\n", b"bc" * 30, "é ü".encode(), (b"word " * 300_000), b"x"]
    hashes, counts = hash_words(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    alone = np.concatenate([hash_words([t])[0] for t in texts])
    assert np.array_equal(hashes, alone)
    words = [w for t in texts for w in t.split()]
    assert len(set(hashes.tolist())) == len(set(words))
