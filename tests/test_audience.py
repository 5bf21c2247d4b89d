"""Customers counted from words of bits: the rows of the report over sales, for any filter."""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from itertools import product

import pytest
from conftest import SF
from pyspark.sql import functions as F

from salesmart.checks import retail_tables as t
from salesmart.model import ADMIN, RawTables, SalesFilter, Scope, Star
from salesmart.operators import audience
from salesmart.plans import etl, reports
from salesmart.sources.warehouse import open_star, write_star


@pytest.fixture(scope="module")
def star(spark):
    return t.stored(spark, SF).star


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def both(star: Star, flt: SalesFilter, scope: Scope) -> tuple:
    kept = reports.customer_insights(star, flt, scope)
    assert "/fact" not in plan_of(kept) and "/audience_monthly" in plan_of(kept)
    return kept.collect(), reports.customer_insights(replace(star, audience_daily=None), flt, scope).collect()


RANGES = {
    "months": (date(1996, 2, 1), date(1996, 12, 31)),
    "edges": (date(1996, 1, 17), date(1997, 6, 9)),
    "part of a month": (date(1996, 5, 3), date(1996, 5, 30)),
    "one whole month": (date(1996, 2, 1), date(1996, 2, 29)),
    "one day": (date(1997, 3, 5), date(1997, 3, 5)),
    "open end": (date(1996, 6, 15), date.max),
    "reversed": (date(1997, 3, 5), date(1996, 3, 5)),
}
LISTS = [{}, {"categories": "PROMO,SMALL"}, {"regions": "ASIA,EUROPE"}, {"stores": "1,2,3", "categories": "ECONOMY", "regions": "AFRICA,AMERICA,ASIA"}]


@pytest.mark.parametrize("name", RANGES)
def test_any_filter_gives_the_rows_of_the_sales(star, name):
    for lists, scope in product(LISTS, (ADMIN, Scope("store_manager", store_id=3))):
        kept, expected = both(star, SalesFilter(*RANGES[name], **lists), scope)
        assert [tuple(r) for r in kept] == [tuple(r) for r in expected]
    if name == "reversed":
        assert kept == []


def test_all_dates_and_no_store(star):
    kept, expected = both(star, SalesFilter(all_dates=True), ADMIN)
    assert kept == expected and sum(r.customer_count for r in kept) == star.fact.select("customer_id").distinct().count()
    assert reports.customer_insights(star, SalesFilter(all_dates=True), Scope("store_manager")).collect() == []


def test_scans_are_pruned(star):
    plan = plan_of(reports.customer_insights(star, SalesFilter(date(1996, 1, 17), date(1997, 6, 9), stores="1,2", categories="PROMO"), ADMIN))
    assert "In(store_id, [1,2])" in plan and "EqualTo(category,PROMO)" in plan
    assert "GreaterThanOrEqual(date,1996-01-17)" in plan and "make_date" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0]
    assert "customer_id" not in plan and "Python" not in plan


def test_numbers_fill_words(spark):
    customers = spark.range(1000).selectExpr("id * 1000003 as customer_id", "if(id % 3 = 0, null, concat('a', id % 3)) as age_group", "if(id % 2 = 0, 'F', null) as gender")
    rows = audience.numbered_customers(customers).collect()
    assert len({(r.word, r.bit) for r in rows}) == len(rows) == 1000
    assert all(bin(r.bit & (2**64 - 1)).count("1") == 1 for r in rows)
    assert len({r.word for r in rows}) <= 1000 // 64 + 1 + 8  # dense but for the ends of tasks


def test_odd_rows(spark, tmp_path):
    """Cohorts and categories that are null, negative numbers of customers, unpriced sales, one customer with most sales."""
    n = 3000
    sales = spark.range(n).selectExpr(
        "id as sale_id", "timestamp_ntz'2024-01-30 00:00:00' + make_dt_interval(cast(id % 70 as int)) as sale_date", "id % 3 as store_id",
        "id % 5 as product_id", "case when id % 3 < 2 then -5 else id % 400 - 200 end as customer_id", "cast(1 as int) as quantity",
        "cast(if(id % 7 = 0, null, 10 + id % 4) as decimal(12,2)) as revenue", "cast(5 as decimal(12,2)) as cost", "cast(5 as decimal(12,2)) as profit",
    )
    stores = spark.range(3).selectExpr("id as store_id", "'s' as store_name", "'c' as city", "concat('r', id) as region", "'mall' as store_type", "date'2000-01-01' as opening_date")
    products = spark.range(5).selectExpr(
        "id as product_id", "'p' as product_name", "if(id = 0, null, concat('k', id % 2)) as category", "'b' as brand",
        "cast(10 as decimal(12,2)) as price", "cast(6 as decimal(12,2)) as cost",
    )
    customers = spark.range(-300, 300).selectExpr(
        "id as customer_id", "'n' as customer_name", "if(id % 2 = 0, 'F', null) as gender", "cast(null as int) as age",
        "if(id % 3 = 0, null, concat('a', id % 3)) as age_group", "'e' as email", "'c' as city",
    )
    raw = RawTables(stores, products, customers, sales)
    star = etl.conform(raw, unique_sales=True)
    write_star(star, str(tmp_path / "odd"))
    stored = open_star(spark, str(tmp_path / "odd"))
    assert stored.fact.where("revenue is null").count() > 0
    for flt in (SalesFilter(all_dates=True), SalesFilter(date(2024, 1, 31), date(2024, 3, 15)), SalesFilter(date(2024, 1, 1), date(2024, 3, 3), categories="k0")):
        kept, expected = both(stored, flt, ADMIN)
        assert sorted(map(str, kept)) == sorted(map(str, expected)) and kept
    write_star(replace(star, fact=star.fact.where(F.lit(False))), str(tmp_path / "none"))
    assert reports.customer_insights(open_star(spark, str(tmp_path / "none")), SalesFilter(all_dates=True), ADMIN).collect() == []
