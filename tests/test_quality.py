from __future__ import annotations

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesmart.functions.columns import age_band
from salesmart.model import RawTables
from salesmart.operators import quality
from salesmart.operators.dedupe import duplicate_count, keep_first
from salesmart.operators.quantile import approximate_quantiles, exact_quantiles
from salesmart.plans import etl

SALE = "sale_id bigint, sale_date string, store_id bigint, product_id bigint, customer_id bigint, quantity int, revenue decimal(12,2), cost decimal(12,2), profit decimal(12,2)"


def money(spark, rows, names="revenue double, quantity int, profit double"):
    return spark.createDataFrame(rows, names)


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None), (4, "b")], "store_id int, city string")
    rows = {r.column_name: (r.nulls, r.null_pct) for r in quality.null_profile(df, "stores").collect()}
    assert rows == {"store_id": (0, 0.0), "city": (2, 50.0)}


def test_duplicates_count_null_keys_as_equal(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "sale_id int")
    assert duplicate_count(df, "sale_id").first().duplicates == 3
    assert duplicate_count(df.where("false"), "sale_id").first().duplicates == 0


def test_keep_first_by_order(spark):
    df = spark.createDataFrame(
        [(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 9, "z"), (None, 2, "y"), (None, 1, "x")],
        "sale_id int, line int, v string",
    )
    kept = {(r.sale_id, r.v) for r in keep_first(df, "sale_id", ["line"]).collect()}
    assert kept == {(1, "a"), (2, "z"), (None, "x")}


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 else id + 100000 end as k", "id as v")
    kept = keep_first(df, "k")
    assert kept.where("k = 7").collect()[0].v == 0
    assert kept.count() == 2001
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_iqr(spark):
    row = quality.outlier_summary(money(spark, [(float(v),) for v in (1, 2, 3, 4, 100)], "revenue double")).first()
    assert (row.q1, row.q3, row.lower_bound, row.upper_bound) == (2, 4, -1, 7)
    assert (row.outliers, row.outlier_pct) == (1, 20.0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 101])
def test_exact_quantiles_match_numpy_on_small_tables(spark, n):
    rng = random.Random(n)
    values = [round(rng.uniform(0, 50), 1) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    row = exact_quantiles(df, "v", {"q3": 0.75, "q1": 0.25, "m": 0.5}).first()
    expected = np.quantile(values, [0.25, 0.5, 0.75])
    assert [row.q1, row.m, row.q3] == pytest.approx(list(expected))


def test_quantiles_of_nothing_and_of_one_value(spark):
    empty = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(empty, "v", {"q1": 0.25}).first().q1 is None
    same = spark.createDataFrame([(7.5,)] * 9, "v double")
    assert exact_quantiles(same, "v", {"q1": 0.25, "q3": 0.75}).first() == (7.5, 7.5)


def test_exact_quantiles_on_many_skewed_values(spark):
    """A third of the rows share one value; the brackets hold a sliver of the rest."""
    df = spark.range(400_000).selectExpr(
        "cast(case when id % 3 = 0 then 12.34 else pmod(hash(id), 1000003) / 7.0 end as decimal(14,4)) as v"
    )
    values = np.array([float(r.v) for r in df.collect()])
    row = exact_quantiles(df, "v", {"q1": 0.25, "q3": 0.75}).first()
    assert [row.q1, row.q3] == pytest.approx(list(np.quantile(values, [0.25, 0.75])), abs=1e-9)
    near = approximate_quantiles(df, "v", {"q1": 0.25, "q3": 0.75}).first()
    assert near.q3 == pytest.approx(row.q3, rel=1e-3)


def test_date_parse(spark):
    df = spark.createDataFrame([("2024-01-05 10:00",), ("bad",), (None,)], "sale_date string")
    assert [r.sale_date.date() for r in quality.drop_invalid_dates(df).collect()] == [date(2024, 1, 5)]
    row = quality.date_summary(df).first()
    assert (row.invalid_dates, row.valid_dates) == (2, 1)


RULE_ROWS = [(0.0, 1, 0.0), (10.0, 0, 5.0), (10.0, 1, 11.0), (None, 1, 0.0), (10.0, 1, 10.0)]


def test_business_rules(spark):
    df = money(spark, RULE_ROWS)
    row = quality.rule_summary(df).first()
    assert row.removed_negative_revenue == 2
    assert row.removed_zero_quantity == 1
    assert row.removed_invalid_profit == 1
    assert (row.total_removed, row.rows_kept) == (4, 1)
    assert quality.apply_business_rules(df).count() == 1


def report(spark, rows):
    return spark.createDataFrame(rows, "check_name string, table_name string, item string, value double")


def test_quality_score(spark):
    rows = [
        ("missing_values", "stores", "city", 4.0),
        ("missing_values", "stores", "region", 6.0),
        ("duplicates", "sales", "sale_id", 5.0),
        ("duplicates", "stores", "store_id", 0.0),
        ("outliers", "sales", "outliers", 80.0),
        ("outliers", "sales", "outlier_pct", 8.0),
        ("business_rules", "sales", "removed_zero_quantity", 200.0),
        ("business_rules", "sales", "total_removed", 200.0),
    ]
    assert quality.quality_score(report(spark, rows)).first().quality_score == pytest.approx(95.0)


def test_quality_score_caps_and_floor(spark):
    tables = ("stores", "products", "customers", "sales")
    rows = [("missing_values", t, "x", 1e6) for t in tables] + [("duplicates", t, "x", 1e6) for t in tables]
    assert quality.quality_score(report(spark, rows)).first().quality_score == 0.0
    assert quality.quality_score(report(spark, rows[:1])).first().quality_score == 80.0
    assert quality.quality_score(report(spark, [])).first().quality_score == 100.0


def sample(spark):
    stores = spark.createDataFrame([(1, "a"), (2, "b")], "store_id bigint, store_name string")
    products = spark.createDataFrame([(1, "p")], "product_id bigint, product_name string")
    customers = spark.createDataFrame(
        [(1, "c", "F", 30, "26-35", "c@x", "here")],
        "customer_id bigint, customer_name string, gender string, age int, age_group string, email string, city string",
    )
    line = (1, 1, 1, 1, 10, 5, 5)

    def sale(i, day, store=1, product=1, quantity=1, revenue=10):
        from decimal import Decimal

        return (i, day, store, product, line[2], quantity, Decimal(revenue), Decimal(5), Decimal(revenue - 5))

    sales = spark.createDataFrame(
        [
            sale(1, "1999-03-05 09:30"),
            sale(1, "1999-03-09"),
            sale(2, "1999-03-06", store=2),
            sale(3, "1999-03-07", store=99),
            sale(4, "1999-03-08", product=None),
            sale(5, "never"),
            sale(6, "1999-03-05", quantity=0),
            sale(None, "1999-03-06"),
        ],
        SALE,
    )
    return RawTables(stores, products, customers, sales)


def test_conform(spark):
    star = etl.conform(quality.clean(sample(spark), ["sale_date"]))
    days = {r.date: r for r in star.dim_date.collect()}
    assert [days[d].date_id for d in sorted(days)] == [1, 2, 3, 4]
    assert [days[date(1999, 3, d)].is_weekend for d in (5, 6, 7)] == [False, True, True]
    first = days[date(1999, 3, 5)]
    assert (first.day_of_week, first.month_name, first.quarter_name) == ("Friday", "March", "Q1")
    assert {(r.sale_id, r.date_id) for r in star.fact.collect()} == {(1, 1), (2, 2)}
    assert "email" not in star.dim_customer.columns


def test_rejected_references(spark):
    star = etl.keyed(quality.clean(sample(spark), ["sale_date"]))
    rejected = {(r.sale_id, r.missing) for r in quality.rejected_references(star.fact, star).collect()}
    assert rejected == {(3, "store"), (4, "product")}


def test_age_bands(spark):
    ages = spark.createDataFrame([(a,) for a in (25, 26, 35, 36, 55, 56, None)], "age int")
    bands = [r.b for r in ages.select(age_band(F.col("age")).alias("b")).collect()]
    assert bands == ["18-25", "26-35", "26-35", "36-45", "46-55", "56+", None]
