"""Duplicate keys: count them, keep the first row of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.operators.keys import among, told_words


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """One row: rows beyond the first of each key; null keys equal each other.

    Partial counts per key travel, never the rows, so one very frequent key costs
    no more than a rare one.
    """
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    )


def keep_first(df: DataFrame, key: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first row of each key.

    A distributed table has no file order, so "first" is by ``order_by`` and then by all
    other columns in schema order: the same row however the table is partitioned. Because only row number 1 is wanted, the planner
    also applies the limit before the shuffle: each task sends one row per key, and
    a key that holds a third of the table arrives as one row per task.
    """
    return _first(df, key, order_by)


REPEATED_WORDS = 1_000_000  # words of bits of keys that occur more than once, up to which they are told to every task
REPEATED_KEYS = 64 * REPEATED_WORDS


def keep_first_sorted_apart(df: DataFrame, key: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """The same rows as ``keep_first``, for a table of whole-number keys that can be read several times.

    Keys are counted first, which shuffles nothing but keys. Only rows of keys that occur more
    than once, or are null, are then shuffled and sorted; the others are first as they are. Where
    too many keys are repeated to tell every task, all rows are sorted.
    """
    repeated = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    words = told_words(repeated, key, REPEATED_KEYS, REPEATED_WORDS)
    if words is None:
        return _first(df, key, order_by)
    alone = among(df.where(F.col(key).isNotNull()), words, key, "left_anti")
    several = among(df, words, key).unionByName(df.where(F.col(key).isNull()))
    return alone.unionByName(_first(several, key, order_by)).select(*df.columns)


def _first(df: DataFrame, key: str, order_by: Sequence[str] | None) -> DataFrame:
    order = list(order_by or [])
    order += [c for c in df.columns if c != key and c not in order]
    position = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_position", position).where("_position = 1").drop("_position")
