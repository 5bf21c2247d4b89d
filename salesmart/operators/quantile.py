"""Exact quantiles of a column of any size."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEW = 100_000  # values that one task may put in order
ACCURACY = 10_000  # of the sketch that proposes brackets
BRACKET = 8  # ranks in ACCURACY that a bracket spans at most: two on each side, and the sketch's error


def _ranked(values: DataFrame, brackets: list[tuple[float, float]], ranks: set[int]) -> dict[int, float]:
    """The values of those ``ranks`` that lie in a bracket, by one scan.

    Values inside a bracket are counted one by one, others by the gap between brackets that they are in.
    """
    value = F.col("v")
    within, gap = F.lit(False), F.lit(0)
    for low, high in brackets:
        within = within | value.between(low, high)
        gap = gap + (value > high).cast("int")
    counted = values.groupBy(gap.alias("gap"), F.when(within, value).alias("exact")).agg(F.count("*").alias("n"), F.min("v").alias("first"))
    placed = counted.withColumn("end", F.sum("n").over(W.orderBy("first")))  # the brackets' values and a row for each gap
    wanted = F.array(*(F.lit(r).cast("long") for r in sorted(ranks)))
    hit = placed.where("exact is not null").withColumn("rank", F.explode(F.filter(wanted, lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n")))))
    return {r.rank: r.exact for r in hit.select("rank", "exact").collect()}


def exact_quantiles(df: DataFrame, column: str, probabilities: dict[str, float]) -> DataFrame:
    """One row of linearly interpolated quantiles; nulls and NaN are left out.

    The built-in exact ``percentile`` gathers every distinct value in one task. Here each
    wanted rank is bracketed: a sketch, which also counts all values, proposes two values around
    it. Where the brackets can be told to hold ``FEW`` values at most, a second scan counts each
    value inside them and all values between them, which tells every rank: two scans in all. In
    larger tables a count first tells where each rank lies, and its part is bracketed again until
    it is one value or that small. Brackets follow ranks, not the range of the values, so outliers
    don't widen them. Only counts and the proposed values reach the driver.
    """
    spark = df.sparkSession
    value = F.col("v")
    values = df.select(F.col(column).cast("double").alias("v")).where(value.isNotNull() & ~F.isnan(value))
    ends = [F.lit(min(1.0, max(0.0, p + d / ACCURACY))) for p in probabilities.values() for d in (-2, 2)]
    n, proposed = values.agg(F.count("*"), F.percentile_approx(value, F.array(*ends), F.lit(ACCURACY))).first() if ends else (0, [])
    position = {name: p * (n - 1) for name, p in probabilities.items()}
    if n == 0:
        return spark.range(1).select(*(F.lit(None).cast("double").alias(name) for name in probabilities))
    found: dict[int, float] = {}
    # rank -> open interval that holds it, values before the interval, values in it
    todo = {r: (None, None, 0, n) for at in position.values() for r in (floor(at), ceil(at))}

    if BRACKET * n <= FEW * ACCURACY:
        brackets = [tuple(proposed[i : i + 2]) for i in range(0, len(proposed), 2)]
        found = _ranked(values, brackets, {r for at in position.values() for r in (floor(at), ceil(at))})
        todo = {r: whole for r, whole in todo.items() if r not in found}

    def inside(rank: int) -> Column:
        low, high = todo[rank][:2]
        return (F.lit(True) if low is None else value > low) & (F.lit(True) if high is None else value < high)

    while wide := [r for r in todo if todo[r][3] > FEW]:
        cuts = {}
        for r in wide:
            share = (r - todo[r][2] + 0.5) / todo[r][3]
            cuts[r] = F.array(*(F.lit(min(1.0, max(0.0, share + d / ACCURACY))) for d in (-2, 2)))
        told = values.agg(*(F.percentile_approx(F.when(inside(r), value), cuts[r], F.lit(ACCURACY)).alias(str(r)) for r in wide)).first()
        counts = values.agg(
            *(
                F.count_if(inside(r) & test(F.lit(bound))).alias(f"{r}_{i}")
                for r in wide
                for i, (bound, test) in enumerate(
                    ((told[str(r)][0], value.__lt__), (told[str(r)][0], value.__eq__), (told[str(r)][1], value.__lt__), (told[str(r)][1], value.__eq__))
                )
            )
        ).first()
        for r in wide:
            low, high, before, size = todo[r]
            a, b = told[str(r)]
            below, at_a, below_b, at_b = (counts[f"{r}_{i}"] for i in range(4))
            k = r - before
            if k < below:
                todo[r] = (low, a, before, below)
            elif k < below + at_a:
                found[r] = a
            elif k < below_b:
                todo[r] = (a, b, before + below + at_a, below_b - below - at_a)
            elif k < below_b + at_b:
                found[r] = b
            else:
                todo[r] = (b, high, before + below_b + at_b, size - below_b - at_b)
            if r in found:
                del todo[r]
    for r in todo:
        counted = values.where(inside(r)).groupBy("v").agg(F.count("*").alias("n"))
        ends = counted.withColumn("end", F.sum("n").over(W.orderBy("v")))  # at most FEW rows
        found[r] = ends.where(F.col("end") > r - todo[r][2]).agg(F.min("v")).first()[0]

    def quantile(at: float) -> float:
        below, above = found[floor(at)], found[ceil(at)]
        return below if below == above else below + (above - below) * (at % 1)

    return spark.range(1).select(*(F.lit(float(quantile(at))).alias(name) for name, at in position.items()))


def approximate_quantiles(df: DataFrame, column: str, probabilities: dict[str, float]) -> DataFrame:
    """The same row from a single pass: sketched, and without interpolation."""
    cuts = F.percentile_approx(column, F.array(*map(F.lit, probabilities.values())))
    return df.agg(cuts.alias("cut")).select(
        *(F.col("cut")[i].cast("double").alias(name) for i, name in enumerate(probabilities))
    )
