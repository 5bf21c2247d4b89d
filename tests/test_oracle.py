"""Every registered query against its SQL twin; models by their invariants."""

from __future__ import annotations

import pytest
from compare import connect, differences
from conftest import SF

import __spark_entry__ as registered

QUERIES = {n: q for n, q in registered.queries().items() if n not in registered.LLM_QUERIES}
ORACLE = {n: q for n, q in registered.oracle_sql().items() if n not in registered.LLM_ORACLE}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"forecast_arima_by_store", "forecast_seasonal_by_store"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF), duck, ORACLE[name]) == []


def test_segments_cover_all_customers(spark):
    assigned = QUERIES["customer_segments"](spark, SF).collect()
    sizes = QUERIES["segment_summary"](spark, SF).collect()
    assert len({r.customer_id for r in assigned}) == len(assigned) == 150
    assert len(sizes) == 4 and sum(r.customers_count for r in sizes) == 150
    assert all(r.customers_count > 0 for r in sizes)


@pytest.mark.parametrize("name", ["forecast_arima_by_store", "forecast_seasonal_by_store"])
def test_forecasts_every_series(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    months = {(1998, m) for m in range(1, 7)}
    by_store = {}
    for r in rows:
        by_store.setdefault(r.store_id, set()).add((r.year, r.month))
    assert len(by_store) == 10 and all(v == months for v in by_store.values())
    assert all(r.is_forecast and r.revenue == r.revenue for r in rows)


def test_entry(spark):
    (row,) = registered.entry(spark).collect()
    assert row.total_transactions == 1377
