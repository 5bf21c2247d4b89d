"""Customer features and k-means segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.functions.columns import ratio
from salesmart.model import SalesFilter, Scope, Star
from salesmart.operators.kmeans import first_centres, lloyd, nearest_centre
from salesmart.operators.sales import select_sales, transactions
from salesmart.sources.shared import settle

# Fixed value: the most rounds of a start.
MOST_ITERATIONS = 300
FEATURES = ["transactions", "total_revenue", "avg_order_value", "total_quantity"]


def customer_features(star: Star, flt: SalesFilter, scope: Scope) -> DataFrame:
    """Four features per customer with sales, nulls as 0."""
    totals = (
        select_sales(star, flt, scope)
        .groupBy("customer_id")
        .agg(
            transactions(star).alias("transactions"),
            F.sum("revenue").cast("double").alias("total_revenue"),
            ratio(F.sum("revenue"), F.count("revenue")).alias("avg_order_value"),
            F.sum("quantity").alias("total_quantity"),
        )
    )
    people = star.dim_customer.select("customer_id", "age_group", "gender")
    return totals.join(people, "customer_id").fillna(0, FEATURES)


def standardise(features: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Add z-scores (population deviation); a constant feature becomes 0.

    Means and deviations are one aggregate row, read as a scalar subquery. The
    features are read twice, so hand in a stored table where they cost much.
    """
    moments = features.agg(
        *(F.avg(c).alias(f"{c}_mean") for c in columns),
        *(F.stddev_pop(c).alias(f"{c}_std") for c in columns),
    )
    row = moments.select(F.struct(*moments.columns)).scalar()
    scores = {
        f"{c}_z": F.coalesce(F.try_divide(F.col(c) - row[f"{c}_mean"], row[f"{c}_std"]), F.lit(0.0))
        for c in columns
    }
    return features.withColumns(scores)


def segment_customers(
    features: DataFrame, clusters: int = 4, seed: int = 42, restarts: int = 10
) -> DataFrame:
    """Features with a ``segment``; no rows when there are fewer customers than clusters.

    The best of several starts of k-means on the standardised features, which are stored
    once; all starts advance in one scan a round until no customer changes its segment.
    Draws follow hashes of the customers' numbers, so the same seed gives the same segments
    however the features came; segments are numbered by mean revenue.
    """
    scores = [f"{c}_z" for c in FEATURES]
    points = settle(standardise(settle(features, "customer_features")), "customer_scores")
    if points.limit(clusters).count() < clusters:
        return features.withColumn("segment", F.lit(None).cast("int")).where(F.lit(False))
    centres = first_centres(points, "customer_id", scores, clusters, seed, restarts)
    found, cost, _ = lloyd(points, "customer_id", scores, centres, MOST_ITERATIONS)
    best = found[int(cost.argmin())]
    placed = points.withColumn("_found", nearest_centre(scores, best)).select(*features.columns, "_found")
    means = placed.groupBy("_found").agg(F.avg("total_revenue").alias("_mean"))  # one row a segment
    numbered = means.select("_found", (F.row_number().over(W.orderBy("_mean", "_found")) - 1).alias("segment"))
    return placed.join(F.broadcast(numbered), "_found").drop("_found")


def segment_totals(segmented: DataFrame) -> DataFrame:
    """One row: customers and the sums of their features, put together from the summary."""
    summary = segment_summary(segmented)
    n = F.col("customers_count")
    return summary.agg(
        F.sum(n).alias("customers"),
        *(F.sum(n * F.col(m)).alias(c) for c, m in zip(FEATURES, ("avg_transactions", "avg_revenue", "avg_order_value", "avg_quantity"))),
    )


def misplaced_customers(segmented: DataFrame, slack: float = 1e-6) -> DataFrame:
    """One row: customers that are nearer to the centre of another segment than to their own's.

    Centres are means of the standardised features. Comparing takes one array of centres,
    a row per segment.
    """
    scores = [f"{c}_z" for c in FEATURES]
    table = standardise(segmented)
    centres = table.groupBy("segment").agg(F.array(*(F.avg(z) for z in scores)).alias("centre"))
    every = centres.agg(F.collect_list(F.struct("segment", "centre"))).scalar()
    own = F.array(*scores)

    def distance(centre: Column) -> Column:
        return F.aggregate(F.zip_with(own, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    judged = table.withColumn("_centres", every).withColumn("_distances", F.transform("_centres", lambda c: F.struct(c["segment"].alias("segment"), distance(c["centre"]).alias("d"))))
    mine = F.array_max(F.transform(F.filter("_distances", lambda c: c["segment"] == F.col("segment")), lambda c: c["d"]))
    nearest = F.array_min(F.transform("_distances", lambda c: c["d"]))
    return judged.agg(F.count("*").alias("customers"), F.count_if(mine > nearest + slack).alias("misplaced"))


def segment_summary(segmented: DataFrame) -> DataFrame:
    return (
        segmented.groupBy("segment")
        .agg(
            F.count("customer_id").alias("customers_count"),
            F.avg("transactions").alias("avg_transactions"),
            F.avg("total_revenue").alias("avg_revenue"),
            F.avg("avg_order_value").alias("avg_order_value"),
            F.avg("total_quantity").alias("avg_quantity"),
        )
        .orderBy("segment")
    )
