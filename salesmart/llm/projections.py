"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors, less their mean, are sorted by the concatenated signs of random
projections and each is compared with its next neighbours. Pairs that the cosine confirms
are united over all passes. Each pass also measures how many signs a window's worth of
neighbours shares with a vector, and so how likely a link of it is missed: vectors that the
passes did not serve well enough, as those of a dense cluster, get further passes around
their own mean or, where that costs less, are compared with each other in blocks. Equal
vectors are one representative from the start; inside each component found, all pairs are
then counted in blocks, so that a dense group larger than a window loses no link.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.components import components
from salesmart.llm.stored import settle

COSINE = 0.95
WINDOW = 32  # next neighbours that a vector is compared with in a pass
BITS = 62  # signs in a sort key
MISSED = 0.005  # share of links at the threshold that may be missed
BLOCK = 1024  # members of a component compared with each other in one go
PASSES = 64  # most passes of one round after the first
CHEAPER = 16  # comparisons in a block that cost as much as one in a window


def passes_for(vectors: int, cosine: float = COSINE, window: int = WINDOW, missed: float = MISSED) -> int:
    """How many passes find all but a share ``missed`` of the links right at the threshold.

    Two such vectors are neighbours where their first signs agree, as many of them as leave
    a window's worth of vectors. That holds for vectors spread evenly; for others the passes
    measure how many signs it takes.
    """
    agree = 1 - math.acos(cosine) / math.pi
    signs = max(0.0, math.log2(max(1, vectors) / window)) + 2
    return max(4, math.ceil(math.log(missed) / math.log(1 - min(0.999, agree**signs))))


def _matrix(lists: pa.ListArray, length: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, length)


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def _means(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean direction of the vectors of each length; the driver gets one row a task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for length in np.unique(lengths):
                units = _units(_matrix(batch.filter(pa.array(lengths == length)).column(1), length))
                sums[length] = sums.get(length, 0) + np.r_[len(units), units.sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([*sums.values()], pa.list_(pa.float64()))], ["length", "sums"])

    means: dict[int, np.ndarray] = {}
    for length, sums in vectors.mapInArrow(run, "length int, sums array<double>").collect():
        means[length] = means.get(length, 0) + np.array(sums)
    return {length: sums[1:] / sums[0] for length, sums in means.items()}


def _keyed(vectors: DataFrame, passes: int, cosine: float, turn: int = 0) -> DataFrame:
    """Sort keys of all passes, and ``agree``: the least chance that a link of the vector agrees in a sign.

    A link is at most ``sqrt(2 - 2 cosine)`` away, so seen from the mean it is within an
    angle that follows from the vector's own distance to it.
    """
    means = vectors.sparkSession.sparkContext.broadcast(_means(vectors))
    away = math.sqrt(max(0.0, 2 - 2 * cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype="i8")
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for length in np.unique(lengths):
                some = batch.filter(pa.array(lengths == length))
                rows = _units(_matrix(some.column(1), length)) - means.value[length]
                far = np.sqrt((rows * rows).sum(axis=1))
                agree = np.where(far > away, 1 - np.arcsin(np.minimum(1.0, away / np.maximum(far, 1e-300))) / math.pi, 0.0)
                if length not in planes:
                    planes[length] = np.random.default_rng([20, int(length), turn]).standard_normal((length, passes * BITS))
                signs = (rows @ planes[length] > 0).reshape(len(rows), passes, BITS)
                keys = signs @ weight
                for k in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(np.full(len(rows), x, "i4")) for x in (k, length)), pa.array(keys[:, k]), *some.columns, pa.array(agree)],
                        ["turn", "length", "sort", "vec_id", "vector", "agree"],
                    )

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.mapInArrow(run, f"turn int, length int, sort bigint, vec_id bigint, vector {kind}, agree double")


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first signs two keys share."""
    other = a ^ b
    high = other >> 31
    return BITS - np.where(high > 0, np.frexp(high.astype("f8"))[1] + 31, np.frexp(other.astype("f8"))[1])


def _neighbours(keyed: DataFrame, cosine: float, window: int) -> DataFrame:
    """Confirmed pairs ``a`` and ``b`` within the window of each sorted run; and for each vector
    and run a row of ``a`` and ``missed``, the log of the chance that the run missed a link of it.

    What agrees with a vector in more signs than the vectors at both ends of its window is
    inside the window. Where the window is cut by the border of a task, nothing is sure.
    """
    names = ["a", "b", "missed"]

    def told(ids: np.ndarray, agree: np.ndarray, before: np.ndarray, after: np.ndarray | int) -> pa.RecordBatch:
        most = np.maximum(before, after)
        found = np.where(most >= BITS, 0.0, agree ** (most + 1.0))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(np.log1p(-np.minimum(found, 1 - 1e-12)))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        whole = context is not None and context.partitionId() == 0  # nothing of the run stands in a task before
        tail: tuple | None = None
        for batch in batches:
            turn, length, sort, ids, agrees = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 5))
            edges = np.flatnonzero(np.r_[True, (turn[1:] != turn[:-1]) | (length[1:] != length[:-1])])
            for start, end in zip(edges, [*edges[1:], len(turn)]):
                of = (int(turn[start]), int(length[start]))
                new = (_units(_matrix(batch.column(4).slice(start, end - start), of[1])), ids[start:end], sort[start:end], agrees[start:end])
                old = 0
                if tail is not None and tail[0] == of:
                    old = len(tail[2])
                    rows, own, keys, agree = (np.concatenate(x) for x in zip(tail[1:5], new))
                    before = np.r_[tail[5], np.empty(end - start, "i8")]
                else:
                    if tail is not None:
                        yield told(tail[2], tail[4], tail[5], -1)
                        whole = True
                    (rows, own, keys, agree), before = new, np.empty(end - start, "i8")
                before[old:] = -1 if whole else BITS
                ahead = _shared(keys[:-window], keys[window:])
                before[max(old, window) :] = ahead[max(0, old - window) :]
                if len(ahead):
                    yield told(own[:-window], agree[:-window], before[:-window], ahead)
                found_a, found_b = [], []
                for step in range(1, min(window, len(rows) - 1) + 1):
                    first = max(0, old - step)
                    hit = first + np.flatnonzero(np.einsum("ij,ij->i", rows[first : len(rows) - step], rows[first + step :]) >= cosine)
                    found_a.append(own[hit])
                    found_b.append(own[hit + step])
                if found_a and sum(map(len, found_a)):
                    a, b = np.concatenate(found_a), np.concatenate(found_b)
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.float64())], names)
                tail = (of, *(x[-window:] for x in (rows, own, keys, agree, before)))
        if tail is not None:
            yield told(tail[2], tail[4], tail[5], BITS)

    sorted_ = keyed.repartitionByRange("turn", "length", "sort", "vec_id").sortWithinPartitions("turn", "length", "sort", "vec_id")
    return sorted_.mapInArrow(run, "a bigint, b bigint, missed double")


def _linked(vectors: DataFrame, cosine: float, window: int, passes: int | None) -> DataFrame:
    """Pairs that tie together all vectors that are linked, each link missed with a chance of ``MISSED`` at most.

    Given a number of passes, there are just these.
    """
    todo = vectors.withColumn("known", F.lit(0.0))
    turns = passes_for(vectors.count(), cosine, window) if passes is None else passes
    found: list[DataFrame] = []
    turn = 0
    while True:
        seen = settle(_neighbours(_keyed(todo.select("vec_id", "vector"), turns, cosine, turn), cosine, window), "links")
        found.append(seen.where("b is not null").select("a", "b").distinct())
        if passes is not None:
            break
        told = seen.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("missed").alias("missed"))
        told = todo.join(told, "vec_id").withColumn("known", F.col("known") + F.col("missed"))
        more = F.greatest(F.lit(0.0), (F.lit(math.log(MISSED)) - F.col("known")) / F.least(F.col("missed"), F.lit(-1e-12)) * turns)
        todo = settle(told.where(F.col("known") > math.log(MISSED)).select("vec_id", "vector", "known", more.alias("more")), "left")
        left, needed = todo.agg(F.count("*"), F.percentile_approx("more", 0.5)).first()
        if not left:
            break
        turn += 1
        if left <= 2 * window * CHEAPER * needed:
            whole = todo.select("vec_id", "vector", F.size("vector").alias("component"))
            sizes = whole.groupBy("component").agg(F.count("*").alias("size"))
            found.append(settle(_in_blocks(whole.join(sizes, "component"), cosine, _tied, "a bigint, b bigint"), "links"))
            break
        todo, turns = todo.drop("more"), max(4, min(PASSES, math.ceil(needed)))
    links = found[0]
    for some in found[1:]:
        links = links.unionAll(some)
    return links


def _in_blocks(members: DataFrame, cosine: float, task: Callable, schema: str) -> DataFrame:
    """What ``task`` tells of each pair of blocks of a component, from its numbers, blocks, vectors and other columns.

    A large component is cut into blocks, and each pair of blocks is compared on its own.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("vec_id"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    more = [c for c in members.columns if c not in ("component", "size", "vec_id", "vector")]
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", *more, "vector")
    keys = ["component", "i", "j"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "vec_id")
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def compare(rows: pa.Table) -> pa.RecordBatch:
        ids, own, *others = (rows.column(c).to_numpy() for c in ("vec_id", "own", *more))
        vectors = rows.column("vector").combine_chunks()
        units = _units(_matrix(vectors, len(vectors[0].as_py())))
        left = np.flatnonzero(own == rows.column("i")[0].as_py())
        right = np.flatnonzero(own == rows.column("j")[0].as_py())
        return pa.RecordBatch.from_arrays([pa.array(c) for c in task(ids, units, left, right, cosine, *others)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            place = np.stack([rows.column(k).to_numpy() for k in keys])
            edges = [0, *(1 + np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)))]
            for start, end in zip(edges, edges[1:]):
                yield compare(rows.slice(start, end - start))
            held = rows.slice(edges[-1])
        if held is not None and held.num_rows:
            yield compare(held)

    return dealt.mapInArrow(run, schema)


def _tied(ids: np.ndarray, units: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked between two blocks, as few of them as do."""
    near = units[left] @ units[right].T >= cosine
    up = np.arange(len(ids))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    a, b = [], []
    for i, row in zip(left.tolist(), near):
        hit = right[row]
        for j in hit[up[hit] != up[i]].tolist():
            x, y = top(i), top(j)
            if x != y:
                up[max(x, y)] = min(x, y)
                a.append(min(ids[i], ids[j]))
                b.append(max(ids[i], ids[j]))
    return np.array(a, "i8"), np.array(b, "i8")


def _counted(members: DataFrame, cosine: float) -> DataFrame:
    """``vec_id`` and ``n``: copies of linked representatives in the same component."""

    def count(ids: np.ndarray, units: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.zeros(len(ids), "i8")
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            near = units[some] @ units[right].T >= cosine
            near &= ids[some][:, None] != ids[right][None, :]
            n[some] += near @ copies[right]
            if left[0] != right[0]:
                n[right] += near.T @ copies[some]
        return ids, n

    members = members.select("component", "size", "vec_id", "copies", "vector")
    return _in_blocks(members, cosine, count, "vec_id bigint, n bigint").groupBy("vec_id").agg(F.sum("n").alias("n"))


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, window: int = WINDOW, passes: int | None = None
) -> DataFrame:
    """Per row ``vec_id``, ``n_links``, ``component_id`` and ``kept``.

    Linked are vectors of one length whose cosine, in double precision, is at least
    ``cosine``; null and zero vectors and those with null or non-finite components link with
    nothing. Equal vectors link with each other; rows of one number are taken as one vector
    each. The number of passes follows from the number of different vectors and from what the
    first passes measure unless given.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("vector", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(fine & some, F.lit(False))
    valid = rows.where(usable)
    same = settle(valid.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "representatives")
    shown = same.select("vec_id", "vector")
    links = _linked(shown, cosine, window, passes)
    tied = components(links).withColumnRenamed("node", "vec_id")
    members = settle(same.join(tied, "vec_id"), "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    counted = _counted(members.join(sizes, "component"), cosine)
    told = same.join(tied, "vec_id", "left").join(counted, "vec_id", "left")
    told = told.select("vector", F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.withColumn("usable", usable).join(told.withColumn("usable", F.lit(True)), ["vector", "usable"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
