"""What the load shuffles, and how."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from conftest import SF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.checks.queries import QUERIES
from salesmart.operators import dedupe, quality
from salesmart.operators.audience import daily_audience, monthly_audience
from salesmart.operators.sales import daily_totals
from salesmart.sources.warehouse import _by_store_month


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df) -> list:
    return sorted(map(str, df.collect()))


@pytest.fixture
def keyed(spark):
    rows = [(k, p, d) for k in (1, 1, 1, 2, 3, 3, 4, None, None, 5) for p, d in ((7, "b"),)]
    rows += [(1, 3, "z"), (3, None, "a"), (None, 2, None), (6, None, None), (6, None, None)]
    return spark.createDataFrame(rows, "sale_id bigint, revenue int, note string")


@pytest.mark.parametrize("most", [0, 2, 100])
def test_rows_sorted_apart_are_the_first_ones(keyed, monkeypatch, most):
    monkeypatch.setattr(dedupe, "REPEATED_KEYS", most)
    found = dedupe.keep_first_sorted_apart(keyed, "sale_id", ["revenue"])
    assert found.columns == keyed.columns
    assert rows_of(found) == rows_of(dedupe.keep_first(keyed, "sale_id", ["revenue"]))
    assert dedupe.keep_first_sorted_apart(keyed.where("false"), "sale_id").count() == 0


def test_rows_that_occur_once_are_not_shuffled(keyed):
    assert "BroadcastHashJoin" in plan_of(dedupe.keep_first_sorted_apart(keyed, "sale_id"))


def test_totals_need_one_shuffle(spark):
    rows = [(date(2024, 1 + i % 3, 1 + i % 4), i % 5, i % 7, i % 11, Decimal(i % 9), "AB"[i % 2], i % 6) for i in range(500)]
    fact = spark.createDataFrame(
        rows, "date date, store_id bigint, product_id bigint, quantity int, revenue decimal(12,2), category string, word bigint"
    ).selectExpr(
        "*", "revenue as cost", "revenue as profit", "year(date) as year", "month(date) as month", "'a' as age_group", "'F' as gender", "shiftleft(1L, quantity) as bit"
    )
    dealt = _by_store_month(fact, 4)
    for found, expected in (
        (daily_totals(dealt), daily_totals(fact)),
        (monthly_audience(daily_audience(dealt)), monthly_audience(daily_audience(fact))),
    ):
        assert plan_of(found).count("Exchange") == 1 and "rangepartitioning" in plan_of(found)
        assert rows_of(found) == rows_of(expected)


def test_references_of_known_number_leave_the_fact_in_place(spark, monkeypatch):
    from salesmart.model import Star

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ids = spark.range(50).selectExpr("id as store_id")
        star = Star(spark.range(100).selectExpr("id as store_id"), None, ids, None, None)
        told = quality.keep_valid_references(star.fact, star, ("store",))
        assert "BroadcastHashJoin" in plan_of(told) and told.count() == 50
        monkeypatch.setattr(quality, "BROADCAST_KEYS", 10)
        sorted_ = quality.keep_valid_references(star.fact, star, ("store",))
        assert "SortMergeJoin" in plan_of(sorted_) and sorted_.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_orders_of_the_stream_are_not_made_in_one_task(spark, monkeypatch):
    def refused(self, *_):
        raise AssertionError("all joins in one task")

    monkeypatch.setattr(type(spark.range(1)), "coalesce", refused)
    assert isinstance(found := QUERIES["stream_alerts"](spark, SF), DataFrame)
    assert found.where(F.col("copies") != F.col("ids")).count() == 0


def test_columns_of_cells_are_read_and_written_as_cell_by_cell():
    import pyarrow as pa
    from pyspark.sql import types as T

    from salesmart.sources import cells

    def slowly(kind, raw):
        try:
            return cells.reader_of(kind, False)("n", raw, False)
        except cells.UNREADABLE:
            return None

    odd = ["0x1F", "1e3", " 5", "NaN", "-0", "1.", ".5", "--1", "1-", "12345678901.5", "0.125", "99999999999", "", "٣"]
    for kind in (T.LongType(), T.IntegerType(), T.DecimalType(12, 2)):
        for raw in odd:
            plain = cells.read_plain(kind, [("n", raw, False), None])
            assert plain is None or plain.to_pylist() == [slowly(kind, raw), None], (kind, raw)
        assert cells.read_plain(kind, [("n", "7", False), None]).to_pylist() == [7, None]
    assert cells.read_plain(T.DecimalType(12, 2), [("n", "-7.5", False)]).to_pylist() == [Decimal("-7.50")]
    for kind, values in (
        (T.DecimalType(12, 2), [Decimal("0.00"), Decimal("-9999999999.99"), None]),
        (T.DecimalType(38, 20), [Decimal("1E-20"), Decimal("5")]),
        (T.LongType(), [5, -(10**15), None]),
        (T.LongType(), [10**15 - 1, 0]),
        (T.IntegerType(), [None]),
    ):
        column = pa.array(values, {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString()) or pa.decimal128(kind.precision, kind.scale))
        write = cells.writer_of(kind)
        assert cells.write_column(kind, write, column) == [None if v is None else write(v) for v in column.to_pylist()]
