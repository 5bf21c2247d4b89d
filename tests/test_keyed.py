"""Updates of keyed tables: the rows of one full join, and only the touched buckets written."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from salesmart.operators.upsert import upsert
from salesmart.sources.keyed import KeyedTable

SCHEMA = "store_id bigint, product_id bigint, quantity int, note string"
KEYS = ("store_id", "product_id")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def stock(spark, n=4_000):
    """Store 0 holds a third of all rows."""
    return spark.range(n).selectExpr(
        "if(id % 3 = 0, 0, id % 40) as store_id", "id as product_id", "cast(id % 7 as int) as quantity", "if(id % 5 = 0, null, 'n') as note"
    )


@pytest.fixture
def table(spark, tmp_path):
    def build(**options):
        return KeyedTable(spark, str(tmp_path / "levels"), SCHEMA, KEYS, **options)

    return build


def test_one_percent_by_key_rewrites_its_buckets_only(spark, table):
    levels = table(buckets=256)
    levels.replace(stock(spark))
    before = levels.parts()
    changed = stock(spark).where("product_id % 100 = 0").selectExpr("store_id", "product_id", "quantity + 100 as quantity")
    expected = rows(upsert(stock(spark), changed, KEYS, ["quantity"]))
    assert levels.merge(changed, ["quantity"]) == 2
    assert rows(levels.read()) == expected
    assert rows(levels.read(1)) == rows(stock(spark))
    after = levels.parts()
    rewritten = {b for b in after if after[b] != before[b]}
    assert rewritten == {r[0] for r in changed.select(levels._bucket()).distinct().collect()}
    assert 0 < len(rewritten) <= 40 and set(after) == set(before)


def test_one_store_is_one_bucket(spark, table):
    levels = table(by=("store_id",), buckets=64)
    levels.replace(stock(spark))
    before = levels.parts()
    source = spark.sql("select 0 as store_id, id as product_id, 9 as quantity from range(5000, 5010)")  # int keys, as bigint
    levels.merge(source, ["quantity"], {"note": F.lit("new")})
    after = levels.parts()
    assert sum(after[b] != before.get(b) for b in after) == 1
    assert rows(levels.read().where("product_id >= 5000")) == [(0, i, 9, "new") for i in range(5000, 5010)]
    assert levels.read().count() == 4_010


def test_first_update_empty_update_and_null_keys(spark, table):
    levels = table(buckets=8)
    assert levels.version() == 0 and rows(levels.read()) == []
    none = spark.createDataFrame([], SCHEMA)
    assert levels.merge(none, ["quantity"]) == 0
    levels.merge(spark.createDataFrame([(1, 1, 1, None), (None, 2, 2, "x")], SCHEMA), ["quantity"])
    assert rows(levels.read()) == [(1, 1, 1, None), (None, 2, 2, "x")]
    levels.replace(none)
    assert rows(levels.read()) == [] and levels.version() == 2


def test_two_updates_of_one_version(spark, table):
    levels = table(buckets=8)
    levels.replace(stock(spark, 50))
    levels.merge(stock(spark, 5).selectExpr("store_id", "product_id", "70 as quantity"), ["quantity"])
    with pytest.raises(RuntimeError, match="another update"):  # one that began at version 1
        levels._publish(stock(spark, 3), 1, {})
    assert levels.version() == 2 and levels.read().where("quantity = 70").count() == 5
    assert levels.read().count() == 50


def test_old_versions_go_with_what_only_they_hold(spark, table):
    levels = table(buckets=8)
    levels.replace(stock(spark, 100))
    for i in range(3):
        levels.merge(spark.createDataFrame([(1, 1, i, "n")], SCHEMA), ["quantity"])
    expected = rows(levels.read())
    first = set(levels.parts(1).values()) - set(levels.parts(4).values())
    levels.drop_versions(keep=1)
    assert rows(levels.read()) == expected
    files, path = levels._files()
    assert len(first) == 1 and not any(files.exists(path(f)) for f in first)
    assert levels._versions() == [4]


def test_another_layout_is_an_error(spark, table):
    table(buckets=8).replace(stock(spark, 10))
    with pytest.raises(ValueError, match="8 buckets"):
        table(buckets=16).read()
