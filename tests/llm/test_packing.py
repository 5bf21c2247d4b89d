from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import documents, prose
from tokenizers import Tokenizer

from salesmart.llm import packing
from salesmart.llm.queries import op3_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check_packed(rows, capacity):
    """Every piece in one sequence, gapless from 0 and within the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def check_pieces(rows, texts, capacity):
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add((r.piece, r.start, r.length, r.ids_crc32))
    for doc, text in texts.items():
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        assert found[doc] == {(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))}


def test_query_packs_whole_documents(spark):
    rows = op3_packing(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    check_pieces(rows, texts, 2048)
    least = -(-sum(r.length for r in rows) // 2048)
    assert check_packed(rows, 2048) <= least + 2


@pytest.mark.parametrize("shard", [50_000, 40])
def test_shards_are_packed_together_again(spark, shard, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", shard)
    monkeypatch.setattr(packing, "TOGETHER", 4)
    lengths = np.random.default_rng(3).integers(1, 1500, 600).tolist() + [2048, 2048, 1]
    pieces = spark.createDataFrame([(i, n, 7) for i, n in enumerate(lengths)], "id bigint, length bigint, offset int")
    rows = packing.pack(pieces).collect()
    assert sorted((r.id, r.length) for r in rows) == [*enumerate(lengths)]
    assert check_packed(rows, 2048) <= -(-sum(lengths) // 2048) * 1.02 + 1


def test_sums_of_squares_by_brute_force():
    lengths = np.sort(np.random.default_rng(5).integers(1, 30, 200))[::-1].astype("i8")
    place, offset, gap = packing.sum_of_squares(lengths, 32)
    open_: dict[int, int] = {}
    for i, n in enumerate(lengths.tolist()):
        def total(after):
            counts = {}
            for g in after.values():
                if 0 < g < 32:
                    counts[g] = counts.get(g, 0) + 1
            return sum(c * c for c in counts.values())

        fits = [(total({**open_, b: g - n}), g) for b, g in open_.items() if g >= n]
        chosen = int(place[i])
        if fits:
            best = min(fits)
            assert (total({**open_, chosen: open_[chosen] - n}), open_[chosen]) == best
        else:
            assert chosen not in open_
        assert offset[i] == 32 - open_.get(chosen, 32)
        open_[chosen] = open_.get(chosen, 32) - n
    assert all(gap[i] == open_[int(place[i])] for i in range(len(lengths)))


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, prose(2, 6000)), (4, "same"), (4, "same"), (None, "no number"), (5, prose(3, 2100))]
    pieces = packing.cut(documents(spark, rows), PATH, 128)
    found = packing.pack(pieces, 128).collect()
    check_pieces(found, dict(rows), 128)
    check_packed(found, 128)
    assert sum(r.doc_id == 4 for r in found) == 2 and sum(r.doc_id is None for r in found) == 1
    assert [(r.length, r.piece) for r in found if r.doc_id in (1, 2)] == [(1, 0), (1, 0)]
    assert packing.pack(packing.cut(documents(spark, rows).where("false"), PATH)).count() == 0
    with pytest.raises(Exception, match="length outside"):
        packing.pack(spark.createDataFrame([(1, 0)], "id bigint, length bigint")).count()


def test_pieces_that_pair_with_nothing_stay_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    lengths = np.random.default_rng(4).integers(1030, 1980, 1000).tolist() + [900, 100, 3]
    pieces = spark.createDataFrame([*enumerate(lengths)], "id bigint, length bigint")
    stored, real = [], packing.settle
    monkeypatch.setattr(packing, "settle", lambda df, name: stored.append((name, real(df, name))) or stored[-1][1])
    rows = packing.pack(pieces).collect()
    assert sorted((r.id, r.length) for r in rows) == [*enumerate(lengths)]
    assert check_packed(rows, 2048) <= 1001
    rounds = [df for name, df in stored if name == "packed"]
    assert len(rounds) <= 8
    for df in rounds:
        assert max(r["count"] for r in df.groupBy("shard").count().collect()) <= 100
