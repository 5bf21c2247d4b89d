"""Skewed keys, and a session without a shared folder."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from salesmart.checks import retail_tables as t
from salesmart.model import ADMIN, RawTables, SalesFilter
from salesmart.operators import quality, quantile
from salesmart.operators.dedupe import keep_first
from salesmart.plans import etl, inventory, reports, segments
from salesmart.sources import shared, warehouse


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """30,000 sales; one store, product, customer and day hold a third, one sale id a sixth."""
    n = 30_000
    hot = "id % 3 = 0"
    sales = spark.range(n).selectExpr(
        f"case when {hot} and id % 2 = 0 then 6 else id end as sale_id",
        f"case when {hot} then timestamp_ntz'2024-03-01 10:00:00' "
        "else timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 180 as int)) end as sale_date",
        f"case when {hot} then 1 else id % 20 end as store_id",
        f"case when {hot} then 7 else id % 200 end as product_id",
        f"case when {hot} then 5 else id % 500 end as customer_id",
        "cast(1 + id % 5 as int) as quantity",
        "cast(100 + id % 50 as decimal(12,2)) as revenue",
        "cast(60 as decimal(12,2)) as cost",
        "cast(40 + id % 50 as decimal(12,2)) as profit",
    )
    stores = spark.range(20).selectExpr(
        "id as store_id", "concat('s', id) as store_name", "'c' as city", "concat('r', id % 3) as region",
        "'mall' as store_type", "date'2000-01-01' as opening_date",
    )
    products = spark.range(200).selectExpr(
        "id as product_id", "concat('p', id) as product_name", "concat('k', id % 7) as category", "'b' as brand",
        "cast(10 as decimal(12,2)) as price", "cast(6 as decimal(12,2)) as cost",
    )
    customers = spark.range(500).selectExpr(
        "id as customer_id", "concat('n', id) as customer_name", "if(id % 2 = 0, 'F', 'M') as gender",
        "30 as age", "'26-35' as age_group", "'e' as email", "'c' as city",
    )
    folder = str(tmp_path_factory.mktemp("hot"))
    star = etl.run_etl(RawTables(stores, products, customers, sales), folder, ["revenue", "sale_date"])
    return sales, star


YEAR = SalesFilter(date(2024, 1, 1), date(2024, 12, 31))


def test_hot_keys_keep_every_row(hot):
    sales, star = hot
    expected = sales.select("sale_id").distinct().count()
    assert star.fact.count() == expected == star.fact.select("sale_id").distinct().count()
    top = reports.store_performance(star, YEAR, ADMIN).first()
    plain = star.fact.groupBy("store_id").agg(F.sum("revenue").alias("r")).orderBy(F.desc("r")).first()
    assert (top.store_id, top.revenue) == (plain.store_id, plain.r)
    by_customer = {r.customer_id: r.transactions for r in segments.customer_features(star, YEAR, ADMIN).collect()}
    assert sum(by_customer.values()) == expected and max(by_customer.values()) > 4000
    assert sum(r.quantity for r in reports.category_revenue(star, YEAR, ADMIN).collect()) == sum(
        r.total_qty for r in inventory.demand(star, ADMIN, date(2024, 12, 31), 400).collect()
    )


def test_large_dimensions_give_the_same_reports(spark, hot):
    """With broadcasting off the joins sort-merge, as they would for big dimensions."""
    _, star = hot
    builders = (reports.category_revenue, reports.customer_insights, reports.export_sales, reports.store_performance)
    flt = SalesFilter(date(2024, 1, 1), date(2024, 12, 31), categories="k0,k1", regions="r0,r1")
    before = [b(star, flt, ADMIN).collect() for b in builders]
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for setting in settings:
        spark.conf.set(setting, -1)
    try:
        plans = [b(star, flt, ADMIN) for b in builders]
        assert "SortMergeJoin" in plans[0]._jdf.queryExecution().executedPlan().toString()
        assert [p.collect() for p in plans] == before
    finally:
        for setting in settings:
            spark.conf.unset(setting)


class Session:
    """A session without the setting for the shared folder."""

    def __init__(self, master: str) -> None:
        self.folder, self.master, self.applicationId = None, master, "app-1"
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_the_shared_folder_must_be_named():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session("local[2]"))
    cluster, local = Session("spark://host:7077"), Session("local[2]")
    for session in (cluster, local):
        t.prepare(session)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(cluster)
    assert shared.shared_folder(local).endswith("/salesmart/app-1")  # checks in local mode get a folder of their own


def test_jobs_delete_their_own_copies(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "shared_folder", lambda _: str(tmp_path / "shared"))
    raw = RawTables(*(build(spark, SF) for build in (t.stores, t.products, t.customers, t.sales)))
    star = etl.run_etl(raw, str(tmp_path / "star"), t.SALES_ORDER)
    quality.quality_report(raw, t.SALES_ORDER).collect()
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "shared").glob("*-*")}
    assert left == {"quality_report"} and star.unique_sales and star.fact.count() > 0


def test_first_row_does_not_depend_on_the_partitioning(spark):
    rows = spark.range(4000).selectExpr("id % 3 as k", "1 as tied", "cast((id * 7919) % 1000 as int) as other", "cast(id % 11 as string) as more")
    found = {tuple(sorted(map(tuple, keep_first(rows.repartition(n), "k", ["tied"]).collect()))) for n in (1, 2, 5, 9)}
    assert len(found) == 1


def test_quantiles_with_extreme_values(spark, monkeypatch):
    monkeypatch.setattr(quantile, "FEW", 1000)
    values = np.random.default_rng(3).random(200_000)
    odd = np.r_[values, 1e15, -1e15, np.inf, np.full(30_000, 0.25)]
    df = spark.createDataFrame(pd.DataFrame({"v": odd})).unionByName(spark.range(10).selectExpr("double('nan') as v"))
    wanted = {"q1": 0.25, "half": 0.5, "q3": 0.75, "least": 0.0, "most": 1.0}
    (row,) = quantile.exact_quantiles(df, "v", wanted).collect()
    assert [row[n] for n in wanted] == [np.quantile(odd, p) if p < 1 else np.inf for p in wanted.values()]
    (none,) = quantile.exact_quantiles(df.where("v is null"), "v", wanted).collect()
    assert set(none) == {None}


def test_versions_are_published_whole(spark, tmp_path):
    star, folder = t.stored(spark, SF).star, str(tmp_path / "star")
    with pytest.raises(FileNotFoundError):
        warehouse.open_star(spark, folder)
    assert warehouse.write_star(star, folder) == 1
    broken = replace(star, fact=star.fact.withColumn("quantity", F.raise_error(F.lit("lost")).cast("int")))
    with pytest.raises(Exception, match="lost"):
        warehouse.write_star(broken, folder)
    assert warehouse.open_star(spark, folder).fact.count() == star.fact.count()
    assert [warehouse.write_star(replace(star, unique_sales=False), folder) for _ in range(2)] == [2, 3]
    assert not warehouse.open_star(spark, folder).unique_sales
    warehouse.drop_versions(spark, folder, keep=1)
    assert sorted(p.name for p in (tmp_path / "star").glob("version-*")) == ["version-3"]


def test_pages_are_not_forced_into_memory(spark):
    star = t.stored(spark, SF).star
    flt = SalesFilter(all_dates=True)
    for rows in (None, 50_000_000):
        plan = reports.export_sales(star, flt, ADMIN, rows)._jdf.queryExecution().optimizedPlan().toString()
        assert "broadcast" not in plan.lower()


def test_release_deletes_only_what_was_settled(spark, monkeypatch, tmp_path):
    mine, other = tmp_path / "app-1", tmp_path / "app-2"
    other.mkdir()
    monkeypatch.setattr(shared, "shared_folder", lambda _: str(mine))
    stored = shared.settle(spark.range(5).toDF("n"), "numbers")
    assert stored.count() == 5 and mine.exists() and "numbers-" in stored.inputFiles()[0]
    shared.release(spark)
    assert not mine.exists() and other.exists()


def test_quantiles_take_two_scans(spark, monkeypatch):
    """The sketch with the count of values, then the counts around the wanted ranks."""
    df = spark.range(300_000, numPartitions=4).selectExpr("cast((id * 7919) % 300000 as double) as v")
    scans = []
    real = quantile._ranked
    monkeypatch.setattr(quantile, "_ranked", lambda *a: scans.append(a) or real(*a))
    monkeypatch.setattr(quantile.W, "orderBy", lambda *a, of=quantile.W.orderBy: scans.append(a) or of(*a))
    (row,) = quantile.exact_quantiles(df, "v", {"q1": 0.25, "q3": 0.75}).collect()
    assert (row.q1, row.q3) == (74_999.75, 224_999.25)
    assert len(scans) == 2  # one call, whose window is the only one: no rank was looked for again
