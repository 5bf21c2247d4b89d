"""Keys told to every task as words of bits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from salesmart.model import Star
from salesmart.operators import audience, dedupe, keys, quality

ODD = [0, 1, 63, 64, 65, -1, -64, -65, 2**63 - 1, -(2**63), 5_000_000_000]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def numbers(df) -> list:
    return sorted(str(r[0]) for r in df.collect())


@pytest.mark.parametrize("kind", ["bigint", "int"])
def test_words_hold_just_their_keys(spark, kind):
    held = [(k,) for k in (*ODD[::2], 64, None) if k is None or kind == "bigint" or abs(k) < 2**31]
    rows = [(k,) for k in (*ODD, *ODD[:3], 66, None)]
    table, asked = spark.createDataFrame(held, f"k {kind}"), spark.createDataFrame(rows, "k bigint")
    words = keys.key_words(table, "k")
    for how in ("left_semi", "left_anti"):
        assert numbers(keys.among(asked, words, "k", how)) == numbers(asked.join(table, "k", how))
    assert keys.among(asked, words, "k").columns == ["k"]
    assert keys.told_words(table, "k", len(set(held))) is not None
    assert keys.told_words(table, "k", len(set(held)) - 2) is None and keys.told_words(table, "k", 99, 1) is None
    assert keys.told_words(table.where("false"), "k", 0, 0) is not None


def test_told_keys_are_a_row_for_64_of_them(spark):
    assert keys.key_words(spark.range(64_000), "id").count() == 1000


def test_keys_beyond_the_bound_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    """The planner would broadcast them, as it takes fifty rows, or millions that compress well, for small."""
    star = Star(spark.range(100).selectExpr("id as store_id"), None, spark.range(50).selectExpr("id as store_id"), None, None)
    monkeypatch.setattr(quality, "BROADCAST_KEYS", 10)
    kept = quality.keep_valid_references(star.fact, star, ("store",))
    assert "SortMergeJoin" in plan_of(kept) and "BroadcastHashJoin" not in plan_of(kept) and kept.count() == 50


def test_names_beyond_the_bound_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    monkeypatch.setattr(audience, "BROADCAST_ROWS", 1)
    fact = spark.range(9).selectExpr(
        "date'2024-01-05' as date", "1L as store_id", "id % 3 as product_id", "id % 4 as customer_id", "1.5 as revenue", "2024 as year", "1 as month"
    )
    customers = audience.numbered_customers(spark.range(4).selectExpr("id as customer_id", "'a' as age_group", "'F' as gender"))
    named = audience.named_sales(fact, spark.range(2).selectExpr("id as product_id", "'c' as category"), customers)
    assert "BroadcastHashJoin" not in plan_of(named) and named.count() == 6


def test_repeated_keys_of_many_words_are_sorted(spark, monkeypatch):
    rows = spark.range(20).select((F.col("id") % 10 * 1000).alias("sale_id"), "id")
    told = dedupe.keep_first_sorted_apart(rows, "sale_id")
    monkeypatch.setattr(dedupe, "REPEATED_WORDS", 9)
    all_sorted = dedupe.keep_first_sorted_apart(rows, "sale_id")
    assert "BroadcastHashJoin" in plan_of(told) and "BroadcastHashJoin" not in plan_of(all_sorted)
    assert numbers(told.select("id")) == numbers(all_sorted.select("id")) == sorted(map(str, range(10)))
