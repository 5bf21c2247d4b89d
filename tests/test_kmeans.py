"""Many-start k-means against plain loops over the same draws."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from salesmart.operators import kmeans

COLUMNS = ["x", "y"]


def table(spark, values, parts=3):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, x double, y double").repartition(parts)


def by_hand(values, clusters, seed, start, rounds=300):
    """Centres and cost of one start, one point after the other."""
    values = [tuple(map(float, v)) for v in values]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    centres = []
    for turn in range(clusters):
        waits = []
        for i, v in enumerate(values):
            u = (int(hashlib.md5(f"{seed}:{start}:{turn}:{i}".encode()).hexdigest()[:13], 16) + 1) / 2**52
            d = min((square(v, c) for c in centres), default=1.0)
            waits.append((d == 0, -math.log(u) / d if d else 0.0, i))
        centres.append(values[min(waits)[2]])
    place = None
    for _ in range(rounds):
        new = [min(range(clusters), key=lambda c: (square(v, centres[c]), c)) for v in values]
        if new == place:
            break
        place = new
        groups = [[v for v, p in zip(values, place) if p == c] for c in range(clusters)]
        assert all(groups)
        centres = [tuple(np.mean(g, axis=0)) for g in groups]
    return np.array(centres), sum(square(v, centres[p]) for v, p in zip(values, place))


@pytest.mark.parametrize("clusters", [1, 2, 5])
def test_all_starts_by_hand(spark, clusters):
    values = np.random.default_rng(4).normal(size=(400, 2))
    points = table(spark, values)
    centres = kmeans.first_centres(points, "id", COLUMNS, clusters, 42, 6)
    found, cost, settled = kmeans.lloyd(points, "id", COLUMNS, centres, 300)
    assert settled == [True] * 6
    for start in range(6):
        wanted, least = by_hand(values, clusters, 42, start)
        assert np.allclose(found[start], wanted) and cost[start] == pytest.approx(least)


def test_no_point_is_nearer_to_another_centre(spark):
    values = np.random.default_rng(6).exponential(size=(500, 2))
    points = table(spark, values)
    found, cost, _ = kmeans.lloyd(points, "id", COLUMNS, kmeans.first_centres(points, "id", COLUMNS, 4, 1, 3), 300)
    for centres in found:
        place = ((values[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        assert np.allclose(centres, [values[place == c].mean(axis=0) for c in range(4)])
    best = found[cost.argmin()]
    rows = points.withColumn("c", kmeans.nearest_centre(COLUMNS, best)).collect()
    assert all(r.c == ((np.array([r.x, r.y]) - best) ** 2).sum(axis=1).argmin() for r in rows)


def test_rounds_are_bounded_and_told(spark):
    points = table(spark, np.random.default_rng(8).normal(size=(300, 2)))
    centres = kmeans.first_centres(points, "id", COLUMNS, 5, 3, 2)
    _, cost, settled = kmeans.lloyd(points, "id", COLUMNS, centres, 1)
    assert settled == [False, False] and np.isfinite(cost).all()


def test_empty_centre_takes_the_farthest_point(spark):
    points = table(spark, [(0, 0), (1, 0), (0, 1), (10, 10), (30, 30)])
    centres = np.array([[[0.0, 0.0], [10.0, 10.0], [500.0, 500.0]]])
    found, _, settled = kmeans.lloyd(points, "id", COLUMNS, centres, 50)
    assert settled == [True]
    assert sorted(map(tuple, found[0])) == [(pytest.approx(1 / 3), pytest.approx(1 / 3)), (10, 10), (30, 30)]


def test_equal_points_end(spark):
    points = table(spark, [(1, 1)] * 6)
    centres = kmeans.first_centres(points, "id", COLUMNS, 3, 42, 2)
    found, cost, settled = kmeans.lloyd(points, "id", COLUMNS, centres, 20)
    assert settled == [True, True] and cost.tolist() == [0, 0] and (found == 1).all()


def test_one_job_per_round(spark):
    points = table(spark, np.random.default_rng(2).normal(size=(200, 2))).cache()
    points.count()
    centres = kmeans.first_centres(points, "id", COLUMNS, 3, 42, 10)
    tracker, group = spark.sparkContext.statusTracker(), "rounds"
    spark.sparkContext.setJobGroup(group, group)
    kmeans.lloyd(points, "id", COLUMNS, centres, 2)
    jobs = [j for j in tracker.getJobIdsForGroup(group)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    points.unpersist()
    assert len(jobs) <= 2 * 2  # a shuffle's map stage may count as a job of its own
