from __future__ import annotations

import random
import zlib

import public_tokenizers
import pytest
from compare import connect, differences
from llm_helpers import Sets, documents, near_duplicates, prose, repeated_words
from test_packing import check_packed, check_pieces

import __spark_entry__ as registered
import corpus_pipeline
from salesmart.llm import langid
from salesmart.llm.components import components
from salesmart.llm.oracle import ORACLE
from salesmart.llm.queries import QUERIES
from salesmart.llm.stored import drop, folder, settle, settle_alone

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(300)] + [(7, 7), (5000, 5000), (None, 3)]
    found = Sets({n for e in edges for n in e if n is not None})
    for a, b in edges:
        if a is not None:
            found.join(a, b)
    alone = {n for n in found.up} - {n for a, b in edges if a is not None and a != b for n in (a, b)}
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in rows} == {n: found.find(n) for n in found.up if n not in alone}
    assert len(rows) == len({r.node for r in rows})
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_stored_tables(spark):
    stored = settle(spark.range(5).withColumnRenamed("id", "n"), "numbers")
    assert sorted(r.n for r in stored.collect()) == [0, 1, 2, 3, 4]
    assert folder(spark) in stored.inputFiles()[0]
    drop(stored)
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(stored.inputFiles()[0]).count()


def test_tables_on_the_way_are_deleted(spark):
    outside, on_the_way = settle(spark.range(3), "outside"), []

    def build():
        on_the_way.append(settle(spark.range(4), "inner"))
        return on_the_way[0].unionAll(outside)

    assert settle_alone(build, "all").count() == 7 and outside.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(on_the_way[0].inputFiles()[0]).count()


def test_stages_of_an_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == documents(spark, []).columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == []


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(registered.queries()) and set(ORACLE) <= set(registered.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)]


def test_stages(spark):
    base = prose(5, 80)
    strange = next(d for d in range(110, 200) if zlib.crc32(str(d).encode()) % 4 == 2)  # nothing is learned from it
    rows = [(i, prose(i, 120)) for i in range(60)]
    rows += [(100, base), (101, base + " end"), (102, base.upper()), (103, prose(1, 60) + "\n" + " ".join(prose(2, 120).split()[10:80]) + "\nown words here")]
    rows += [(104, None), (105, "123 456"), (106, ""), (strange, "漢字" * 200), (None, prose(900, 70)), (3, prose(3, 120)), (108, " ".join(prose(4, 120).split()[20:110]))]
    docs = documents(spark, rows)
    stages = dict(corpus_pipeline.STAGES)

    first = stages["language_id"](spark, docs, SF)
    kept = [(r.doc_id, r.text) for r in first.collect()]
    assert first.columns == docs.columns
    assert sorted(kept, key=repr) == sorted([r for r in rows if r[0] not in (104, 105, 106, strange)], key=repr)

    second = stages["near_duplicates"](spark, settle(first, "test"), SF)
    group = near_duplicates([r for r in kept if r[0] is not None])
    expected = sorted([d for d, (_, c) in group.items() if d == c])
    assert group[101][1] == group[102][1] == 100
    assert sorted(r.doc_id for r in second.collect() if r.doc_id is not None) == expected
    assert second.columns == docs.columns and second.where("doc_id is null").count() == 1

    third = stages["substring_dedup"](spark, settle(second, "test"), SF)
    left = [(r.doc_id, r.text) for r in second.collect() if r.doc_id is not None]
    words = repeated_words(left)
    got = {r.doc_id: r for r in third.collect()}
    assert third.columns == docs.columns
    assert {d: " ".join(r.text.split()) for d, r in got.items() if d is not None} == {d: w for d, w in words.items() if w}
    assert got[103].text.endswith("own words here") and got[103].n_chars == len(got[103].text)
    assert got[0].text == prose(0, 120) and 108 not in got

    last = stages["packing"](spark, settle(third, "test"), SF).collect()
    check_pieces(last, {d: r.text for d, r in got.items()}, 2048)
    check_packed(last, 2048)


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = langid.identify(docs, langid.fit(docs)).where("not rejected").collect()
    group = near_duplicates([(r.doc_id, r.text) for r in told])
    left = [(r.doc_id, r.text) for r in told if group[r.doc_id][1] == r.doc_id]
    words = repeated_words(left)
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packed(rows, 2048)
    assert {r.doc_id for r in rows} == {d for d, w in words.items() if w}
    same = {d: t for d, t in left if words[d].split() == t.split()}
    check_pieces([r for r in rows if r.doc_id in same], same, 2048)
