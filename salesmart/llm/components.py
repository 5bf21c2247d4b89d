"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.stored import drop, settle


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``component`` (its smallest reachable node) for each node of an edge.

    ``edges`` has the columns ``a`` and ``b``, integers; direction, loops, repeated rows and
    nulls don't matter. Alternating stars: each node's neighbours are tied to the smallest of them
    until nothing changes, in a number of rounds that grows with the logarithm of the
    longest path. Each round is one stored table of edges; only its size and checksum reach
    the driver. A node with very many neighbours is one row of a minimum and otherwise the
    many side of a join.
    """
    a, b = F.col("a"), F.col("b")
    linked = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    stars, seen = settle(linked, "edges"), None
    while True:
        both = stars.unionAll(stars.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        small = settle(small.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        told = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(stars)
        drop(large)
        stars = small
        if tuple(told) == seen:
            break
        seen = tuple(told)
    found = stars.select(a.alias("node"), b.alias("component"))
    return found.unionAll(stars.select(b.alias("node"), b.alias("component")).distinct())
