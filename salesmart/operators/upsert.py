"""Insert-or-update by key, as one join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str],
    defaults: Mapping[str, Column] | None = None,
    touched: tuple[str, Column] | None = None,
) -> DataFrame:
    """The target after merging ``source``, with the target's columns.

    A new key is inserted whole; a known key has only the ``update`` columns
    replaced. ``defaults`` fill inserted columns the source lacks. ``touched``
    names a column that takes the given value on insert, and on an update that
    changes something. Keys must be unique on each side. Write the result to a
    new place: the target is being read.
    """
    defaults = dict(defaults or {})
    incoming = source.select(
        *keys, *(F.col(c).alias(f"_new_{c}") for c in source.columns if c not in keys), F.lit(True).alias("_new")
    )
    joined = target.withColumn("_old", F.lit(True)).join(incoming, list(keys), "full")
    known, given = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    changed = F.lit(False)
    for c in update:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))

    def merged(c: str) -> Column:
        if c in keys:
            return F.col(c)
        if touched and c == touched[0]:
            return F.when(~known | (given & changed), touched[1]).otherwise(F.col(c)).alias(c)
        fresh = F.col(f"_new_{c}") if c in source.columns else defaults.get(c, F.lit(None))
        replace = given & (~known | F.lit(c in update))
        return F.when(replace, fresh).otherwise(F.col(c)).alias(c)

    return joined.select(*(merged(c) for c in target.columns))
