"""Exact top-k search by inner product over integer vectors: columnar branch and bound.

Candidates lie in blocks, one row of values per dimension. For a block of queries the
products are accumulated over a few dimensions at a time, those with the most mass first.
What the remaining dimensions can still add is bounded by the remaining masses of query
and candidate (Cauchy-Schwarz), and candidates that can't reach the query's k-th best score
so far are dropped from the columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.llm.stored import settle

CANDIDATES, QUERIES = 8192, 64  # vectors in a block
DIMENSIONS = 8  # accumulated between two looks at the bounds
SCALE = 256


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``q``: floor(scale * x) of each component as a whole number.

    Rows with a null number, a null vector or a null or non-finite component are left out.
    A component beyond the range of whole numbers is an error.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col(key).cast("long").alias("vec_id"), whole.alias("q")
    )


def _blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of at most ``size`` vectors of one length, each a row of bytes in vertical layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def block(length: int) -> pa.RecordBatch:
            ids, rows = held.pop(length)
            matrix = np.ascontiguousarray(np.array(rows, "<i8").reshape(len(rows), length).T)
            values = [[length], [len(ids)], [np.array(ids, "<i8").tobytes()], [matrix.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["length", "n", f"{name}_ids", f"{name}_data"])

        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
            for i, (vec_id, start, end) in enumerate(zip(batch.column(0).to_pylist(), [0, *ends], ends)):
                ids, rows = held.setdefault(end - start, ([], []))
                ids.append(vec_id)
                rows.append(flat[start:end])
                if len(ids) == size:
                    yield block(end - start)
        for length in [*held]:
            yield block(length)

    return vectors.mapInArrow(run, f"length int, n int, {name}_ids binary, {name}_data binary")


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """The k best rows of a block for each query, its own number left out; ``rows`` holds a dimension per line."""
    length = len(rows)
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, length)
    if largest >= 2**62:
        raise ValueError("these components are too large for scores of 64 bits")
    squares = rows.astype("f8") ** 2
    for query, own in zip(queries.T, query_ids):
        order = np.argsort(-np.abs(query), kind="stable")
        alive = np.flatnonzero(ids != own)
        if len(alive) > k:
            # Exact scores of a few candidates give the first threshold.
            some = alive[np.argpartition(-(query[order[:DIMENSIONS]] @ rows[order[:DIMENSIONS]])[alive], k - 1)[: 4 * k]]
            threshold = np.partition(query @ rows[:, some], -k)[-k]
        else:
            threshold = None
        score = np.zeros(len(alive), "i8")
        left = squares[:, alive].sum(axis=0) if threshold is not None else None
        for at in range(0, length, DIMENSIONS):
            dims = order[at : at + DIMENSIONS]
            part = rows[np.ix_(dims, alive)]
            score += query[dims] @ part
            if threshold is None:
                continue
            left -= (part.astype("f8") ** 2).sum(axis=0)
            rest = float((query[order[at + DIMENSIONS :]].astype("f8") ** 2).sum())
            reach = score + np.sqrt(np.maximum(left, 0) * rest) * (1 + 1e-9) + 1
            stays = reach >= threshold
            if stays.sum() < len(alive):
                alive, score, left = alive[stays], score[stays], left[stays]
        best = np.lexsort((ids[alive], -score))[:k]
        for i in best:
            yield int(own), int(ids[alive[i]]), int(score[i])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each query's k best candidates: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties to smaller ``vec_id``.

    Both tables have ``vec_id`` and ``q`` (whole numbers); a candidate with the query's own
    number is left out, and vectors of different lengths are not compared. A repeated
    candidate counts once per row, a repeated query gives its rows once. Every block of
    queries meets every block of candidates, and each such pair of blocks gives k rows a query.
    """
    found = settle(_blocks(candidates, CANDIDATES, "c").withColumn("c", F.monotonically_increasing_id()), "candidates")
    asked = settle(_blocks(queries.dropDuplicates(["vec_id"]), QUERIES, "a").withColumn("a", F.monotonically_increasing_id()), "queries")
    places = found.select("length", "c").join(asked.select("length", "a"), "length")
    met = places.join(asked.drop("length", "n"), "a").join(found.drop("length", "n"), "c").select("length", "a_ids", "a_data", "c_ids", "c_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, a_ids, a_data, c_ids, c_data in zip(*(c.to_pylist() for c in batch.columns)):
                ids, own = np.frombuffer(c_ids, "<i8"), np.frombuffer(a_ids, "<i8")
                rows = np.frombuffer(c_data, "<i8").reshape(length, len(ids))
                asked_rows = np.frombuffer(a_data, "<i8").reshape(length, len(own))
                best = [*best_of_block(asked_rows, own, rows, ids, k)]
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*best)], ["query_id", "vec_id", "score"])

    scored = met.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
