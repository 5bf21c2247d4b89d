"""Streams over deliveries: restarts, late and repeated rows, replayed batches."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from conftest import SF

from salesmart.checks import retail_tables as t
from salesmart.model import ADMIN
from salesmart.plans import inventory
from salesmart.sources.schemas import INVENTORY_LEVELS
from salesmart.streaming import alerts, daily, runs

SALES = "sale_id bigint, sale_date timestamp, quantity int, revenue decimal(12,2)"
DAY = datetime(2024, 3, 1)
NOW = datetime(2024, 3, 5, 12)


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, SALES).coalesce(1).write.mode("append").parquet(folder)


def sale(number, day, hour=10, revenue=5):
    return number, DAY + timedelta(days=day, hours=hour), 2, Decimal(revenue)


def days(spark, base, delay="2 days"):
    told = daily.write_closed_days(runs.file_stream(spark, f"{base}/sales", SALES), f"{base}/days", f"{base}/checkpoint", delay)
    rows = daily.read_closed_days(spark, f"{base}/days").collect()
    return told, {(r.date - DAY.date()).days: (float(r.daily_revenue), r.daily_quantity, r.daily_transactions) for r in rows}


def test_days_close_once_and_repeats_do_not_count(spark, tmp_path):
    base = str(tmp_path)
    deliver(spark, f"{base}/sales", [sale(1, 0), sale(2, 0, 23), sale(2, 0, 23), sale(3, 1), sale(4, 3, 1)])
    assert days(spark, base)[1] == {0: (10.0, 4, 2)}
    deliver(spark, f"{base}/sales", [sale(3, 1), sale(5, 1, 20), sale(6, 6)])  # a repeat and a late sale of an open day
    assert days(spark, base)[1] == {0: (10.0, 4, 2), 1: (10.0, 4, 2), 3: (5.0, 2, 1)}


def test_sales_behind_the_watermark_are_counted_as_late(spark, tmp_path):
    base = str(tmp_path)
    deliver(spark, f"{base}/sales", [sale(1, 0), sale(2, 9)])
    assert days(spark, base)[0].late == 0
    deliver(spark, f"{base}/sales", [sale(3, 0), sale(4, 20)])
    told, found = days(spark, base)
    assert told.late >= 1 and found[0] == (5.0, 2, 1)


def test_nothing_new_adds_nothing(spark, tmp_path):
    base = str(tmp_path)
    deliver(spark, f"{base}/sales", [sale(1, 0), sale(2, 9)])
    first = days(spark, base)[1]
    told, again = days(spark, base)
    assert again == first and told.rows == 0


def levels(spark, star, base, stocks):
    pairs = star.fact.select("store_id", "product_id").distinct().orderBy("store_id", "product_id").limit(len(stocks)).collect()
    rows = [(p.store_id, p.product_id, stock, 5, 60, 10, NOW - timedelta(hours=i % 3)) for i, (p, stock) in enumerate(zip(pairs, stocks))]
    spark.createDataFrame(rows, INVENTORY_LEVELS).coalesce(1).write.mode("append").parquet(f"{base}/levels")
    return rows


def watch(spark, star, base, checkpoint, files=None, now=NOW):
    stream = runs.file_stream(spark, f"{base}/levels", INVENTORY_LEVELS, files)
    told = alerts.watch_levels(stream, star, ADMIN, f"{base}/alerts", f"{base}/{checkpoint}", now)
    return told, sorted(r.notification_id for r in alerts.read_alerts(spark, f"{base}/alerts").collect())


@pytest.fixture(scope="module")
def star(spark):
    return t.stored(spark, SF).star


def test_replayed_batches_add_nothing(spark, star, tmp_path):
    base = str(tmp_path)
    levels(spark, star, base, [3, 50, 10, 11])
    levels(spark, star, base, [3, 50, 9, 4])
    told, first = watch(spark, star, base, "checkpoint", 1)
    assert told.batches == 2 and len(first) == len(set(first)) == 4  # one says another quantity
    assert watch(spark, star, base, "checkpoint")[1] == first  # a restart
    assert watch(spark, star, base, "other", 1)[1] == first  # the same batches again
    # all in one batch: of two levels of a pair the newest counts, and nothing is said twice
    again = watch(spark, star, base, "third")[1]
    assert len(again) == len(set(again)) and set(again) <= set(first)


def test_an_interrupted_batch_is_written_again(spark, star, tmp_path):
    base = str(tmp_path)
    levels(spark, star, base, [3, 2, 1])
    write = alerts.batch_writer(f"{base}/alerts", "levels", lambda b: inventory.low_stock_alerts(inventory.reorder_suggestions(star, ADMIN, b)), NOW)
    batch = spark.read.schema(INVENTORY_LEVELS).parquet(f"{base}/levels")
    write(batch.limit(1), 0)  # what a batch left that didn't end
    write(batch, 0)
    write(batch, 1)
    assert alerts.read_alerts(spark, f"{base}/alerts").count() == 3


def test_next_day_says_it_again(spark, star, tmp_path):
    base = str(tmp_path)
    levels(spark, star, base, [3])
    assert len(watch(spark, star, base, "first")[1]) == 1
    assert len(watch(spark, star, base, "second", now=NOW + timedelta(days=1))[1]) == 2


def test_streams_write_side_by_side(spark, star, tmp_path):
    base = str(tmp_path)
    levels(spark, star, base, [3, 4])
    stream = runs.file_stream(spark, f"{base}/levels", INVENTORY_LEVELS)
    orders = inventory.auto_orders(inventory.demand(star, ADMIN, t.AS_OF, 3000)).limit(2)
    orders.coalesce(1).write.parquet(f"{base}/orders")
    ordered = spark.readStream.schema(orders.schema).parquet(f"{base}/orders")
    alerts.watch_levels(stream, star, ADMIN, f"{base}/alerts", f"{base}/one", NOW)
    alerts.watch_orders(ordered, f"{base}/alerts", f"{base}/two", NOW)
    kinds = [r.type for r in alerts.read_alerts(spark, f"{base}/alerts").collect()]
    assert sorted(kinds) == ["auto_order"] * 2 + ["low_stock"] * 2


def test_failing_batch_raises(spark, tmp_path):
    deliver(spark, str(tmp_path / "sales"), [sale(1, 0)])

    def fail(batch, number):
        raise ValueError("no such day")

    with pytest.raises(Exception, match="no such day"):
        runs.run_to_end(runs.file_stream(spark, str(tmp_path / "sales"), SALES).writeStream.foreachBatch(fail), str(tmp_path / "checkpoint"))
