"""K-means with many starts that advance together.

Each round reads the points once for all starts: every task adds its points up by start and
centre, and only such sums reach the driver. A start has ended when no point changes
its centre any more, which is a fixpoint, not a tolerance. The points are never held anywhere.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 14  # points whose distances are held at once
DIRECT = 10_000  # most rows of sums that the driver adds up itself


def squared_distance(columns: Sequence[str], centre: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, x in zip(columns, centre):
        total = total + (F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x)))
    return total


def _chance(key: str, seed: int, start: int, turn: int) -> Column:
    """A number in (0, 1] that key, seed, start and turn decide, from 52 bits of an MD5."""
    text = F.concat(F.lit(f"{seed}:{start}:{turn}:"), F.col(key).cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)


def first_centres(points: DataFrame, key: str, columns: Sequence[str], clusters: int, seed: int, starts: int) -> np.ndarray:
    """Centres to begin with, drawn as k-means++ does: starts x clusters x features.

    A point is drawn with a chance that grows with its squared distance from the centres
    before: the least of -ln(u) / distance wins, u from a hash of the point's key, so the
    draw is one aggregate over all points and doesn't depend on how they are dealt. One
    scan per centre serves all starts. No points give no centres.
    """
    chosen: list[list[np.ndarray]] = [[] for _ in range(starts)]
    width = len(columns)
    names = ["start", "last", "wait", "place", *(f"x{i}" for i in range(width))]
    kind = points.schema[key].dataType.simpleString()
    schema = f"start int, last boolean, wait double, place {kind}, " + ", ".join(f"x{i} double" for i in range(width))
    numbers = points.select(key, *(F.col(c).cast("double") for c in columns))
    for turn in range(clusters):
        chances = [_chance(key, seed, start, turn).alias(f"u{start}") for start in range(starts)]

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The best point of each batch for each start."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                some = np.column_stack([batch.column(1 + c).to_numpy(zero_copy_only=False) for c in range(width)])
                rows = []
                for start in range(starts):
                    wait = -np.log(batch.column(1 + width + start).to_numpy(zero_copy_only=False))
                    last = np.zeros(len(some), bool)
                    if chosen[start]:
                        nearest = _assign(some, np.array(chosen[start]))[1]
                        last = nearest <= 0  # what lies on a centre is drawn last
                        wait = np.where(last, 0.0, wait / np.where(last, 1.0, nearest))
                    ties = pa.table({"last": last, "wait": wait, "place": batch.column(0)})
                    best = pc.sort_indices(ties, [("last", "ascending"), ("wait", "ascending"), ("place", "ascending")])[0].as_py()
                    rows.append((start, bool(last[best]), float(wait[best]), batch.column(0)[best].as_py(), *some[best].tolist()))
                types = [pa.int32(), pa.bool_(), pa.float64(), batch.column(0).type, *[pa.float64()] * width]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        drawn = numbers.select(key, *columns, *chances).mapInArrow(draw, schema)
        first = drawn.groupBy("start").agg(F.min(F.struct(*names[1:])).alias("best"))
        for row in first.collect():
            chosen[row["start"]].append(np.array([row["best"][f"x{i}"] for i in range(width)]))
    return np.array(chosen)


def _assign(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point, the first of equal ones, and its squared distance."""
    distance = np.zeros((len(points), len(centres)))
    for f in range(points.shape[1]):
        distance += (points[:, f : f + 1] - centres[:, f]) ** 2
    nearest = distance.argmin(axis=1)
    return nearest, distance[np.arange(len(points)), nearest]


def _round(points: DataFrame, columns: Sequence[str], before: dict[int, np.ndarray | None], now: dict[int, np.ndarray], tasks: int) -> dict[int, tuple[np.ndarray, np.ndarray, float, int]]:
    """Per start: sums and counts by centre, cost, and how many points changed their centre since ``before``."""
    width = len(columns)
    names = ["start", "centre", "n", "cost", "moved", *(f"s{i}" for i in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: np.zeros((len(c), 3 + width)) for s, c in now.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.slice(at, BLOCK).columns])
                for s, centres in now.items():
                    nearest, distance = _assign(some, centres)
                    old = before[s]
                    moved = np.ones(len(some)) if old is None else (_assign(some, old)[0] != nearest).astype("f8")
                    for column, values in enumerate([np.ones(len(some)), distance, moved, *some.T]):
                        held[s][:, column] += np.bincount(nearest, values, minlength=len(centres))
        rows = [(s, c, *row) for s, sums in held.items() for c, row in enumerate(sums.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i < 2 else pa.float64()) for i in range(len(names))], names)

    schema = "start int, centre int, " + ", ".join(f"{n} double" for n in names[2:])
    sums = points.select(*columns).mapInArrow(run, schema)
    if tasks * sum(map(len, now.values())) > DIRECT:
        sums = sums.groupBy("start", "centre").agg(*(F.sum(n).alias(n) for n in names[2:]))
    out = {s: (np.zeros((len(c), width)), np.zeros(len(c)), 0.0, 0) for s, c in now.items()}
    for row in sums.collect():
        total, n, cost, moved = out[row["start"]]
        total[row["centre"]] += [row[f"s{i}"] for i in range(width)]
        n[row["centre"]] += row["n"]
        out[row["start"]] = (total, n, cost + row["cost"], moved + int(row["moved"]))
    return out


def _farthest(points: DataFrame, key: str, columns: Sequence[str], centres: np.ndarray, many: int) -> list[tuple[int, np.ndarray]]:
    """The ``many`` points farthest from their centres, with these; ties by key."""
    distances = [F.struct(squared_distance(columns, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    nearest = F.array_min(F.array(*distances))
    found = points.withColumn("_near", nearest).where("_near.d > 0").orderBy(F.col("_near.d").desc(), key).limit(many)
    return [(r["_near"]["i"], np.array([float(r[c]) for c in columns])) for r in found.collect()]


def lloyd(points: DataFrame, key: str, columns: Sequence[str], centres: np.ndarray, most_rounds: int) -> tuple[np.ndarray, np.ndarray, list[bool]]:
    """Centres and costs of all starts where no point moves any more; and whether each start got there.

    A centre without points takes the point farthest from its own centre, which leaves that
    one; where no point is away from a centre it stays. One job per round, and one more for a
    start with an empty centre.
    """
    now = {s: c.copy() for s, c in enumerate(centres)}
    before: dict[int, np.ndarray | None] = dict.fromkeys(now)
    cost, settled = np.full(len(centres), np.inf), [False] * len(centres)
    final = centres.copy()
    tasks = points.rdd.getNumPartitions()
    for _ in range(most_rounds):
        for s, (total, n, own, moved) in _round(points, columns, {s: before[s] for s in now}, now, tasks).items():
            final[s], cost[s] = now[s], own
            if not moved:
                settled[s] = True
                del now[s]
                continue
            empty = np.flatnonzero(n == 0)
            if len(empty):
                for c, (old, point) in zip(empty, _farthest(points, key, columns, now[s], len(empty))):
                    if n[old] > 1:
                        total[old], n[old] = total[old] - point, n[old] - 1
                        total[c], n[c] = point, 1
            before[s] = now[s]
            now[s] = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], now[s])
        if not now:
            break
    return final, cost, settled


def nearest_centre(columns: Sequence[str], centres: np.ndarray) -> Column:
    """The number of the nearest centre, the first of equal ones, as a built-in expression."""
    pairs = [F.struct(squared_distance(columns, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return F.array_min(F.array(*pairs))["i"]


# the rounds travel to the workers with the task, installed there or not
cloudpickle.register_pickle_by_value(sys.modules[__name__])
