"""Places of rows within their groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.llm.stored import settle

_INDEX_BITS = 33  # of a row's number within its partition


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, by ``order``, nulls first) and ``of``, the group's size.

    Rows are sorted by range over all tasks, so a group of any size is dealt to many of them; each
    task's part of a group starts where the parts before it end. Rows that agree in all of
    ``group`` and ``order`` get different ranks, in any order. The sorted rows are stored once.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)
    stored = settle(sorted_.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    stored = stored.withColumn("_part", F.shiftright("_at", _INDEX_BITS))
    begins = stored.groupBy("_part", *group).agg(F.min("_at").alias("_begin"), F.count("*").alias("_n"))
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    begins = begins.withColumns({"_before": F.coalesce(before, F.lit(0)), "of": F.sum("_n").over(whole)})
    begins = begins.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(["_part", *group])), "_begin", "_before", "of")
    same: Column = F.col("_part") == F.col("_0")
    for i, c in enumerate(group, start=1):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    placed = stored.join(begins, same)
    return placed.select(*rows.columns, (F.col("_at") - F.col("_begin") + F.col("_before")).alias("rank"), "of")
