"""Packing of tokenised documents into sequences of bounded length, by sums of squares.

A document goes into the open sequence that leaves the smallest sum, over all gaps, of
the squared number of open sequences with that gap; ties go to the smallest gap. Documents
come in falling length, and a new sequence is opened only where no open one has room.
Each shard packs a bounded number of pieces on its own; sequences that stay too empty are
dissolved and packed again, in as many shards as their pieces need, until one shard is
left or the pieces take no fewer sequences than before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.bpe import slices, vocabulary
from salesmart.llm.stored import drop, settle

END = 0  # the token after each document
SHARD = 50_000  # pieces that one task packs, about
TOGETHER = 64  # most shards whose leftovers are packed together
ROUNDS = 64  # most rounds
EMPTY = 1 / 32  # share of a sequence that may stay empty before its pieces are packed again
BIN_BITS, ROUND_BIT = 28, 56

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(docs: DataFrame, path: str, capacity: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document: its tokens and an end token, cut where longer than ``capacity``.

    All pieces of a document but the first are full. A null text counts as empty: one piece
    of length 1. Repeated rows each give their pieces; other columns are left out.
    ``ids_crc32`` is the CRC-32 of the piece's numbers as little-endian 32-bit words.
    """
    schema = PIECES.replace("doc_id bigint", f"`{key}` {docs.select(key).schema[0].dataType.simpleString()}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path, library=True)
        for some in slices(batches, 1):
            numbers = voc.encode_many([x or "" for x in some.column(1).to_pylist()])
            rows: list[tuple[int, int, int, int, int]] = []
            for i, own in enumerate(numbers):
                data = own.tobytes() + END.to_bytes(4, "little")
                n = len(own) + 1
                ends = range((n - 1) % capacity + 1, n + 1, capacity)
                for piece, end in enumerate(ends):
                    start = max(0, end - capacity) if piece else 0
                    rows.append((i, piece, start, end - start, zlib.crc32(data[4 * start : 4 * end])))
            at, piece, start, length, crc = np.array(rows, "i8").T
            yield pa.RecordBatch.from_arrays(
                [some.column(0).take(pa.array(at)), pa.array(piece.astype("i4")), *map(pa.array, (start, length, crc))],
                [key, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(key, text).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset and the sequence's final gap for each length; lengths fall."""
    n = len(lengths)
    if n and (lengths[-1] < 1 or lengths[0] > capacity):
        raise ValueError(f"a piece has a length outside 1 to {capacity}")
    place, offset = np.zeros(n, "i8"), np.zeros(n, "i8")
    full = int(np.searchsorted(-lengths, -capacity, side="right"))
    place[:full] = np.arange(full)
    gap = np.zeros(n, "i8")  # by sequence
    count = np.zeros(capacity + 1, "i8")  # of open sequences by gap
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = full
    for i in range(full, n):
        size = int(lengths[i])
        # How the sum changes; a filled sequence is open no more.
        change = 2 * (count[: capacity + 1 - size] - count[size:]) + 2
        change[0] = 1 - 2 * count[size]
        change[count[size:] == 0] = 2 * n + 3  # more than any change
        at = int(change.argmin())
        if change[at] > 2 * n + 2:
            at, chosen = capacity - size, used
            used += 1
        else:
            chosen = open_[at + size].pop()
            count[at + size] -= 1
        place[i], offset[i], gap[chosen] = chosen, capacity - at - size, at
        if at:
            count[at] += 1
            open_[at].append(chosen)
    return place, offset, gap[place]


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: each piece in one sequence, gapless from 0.

    Lengths outside 1 to ``capacity``, and null ones, are an error. Repeated rows each get a
    place; an empty table gives an empty one. Existing columns ``sequence_id`` and
    ``offset`` are replaced. The pieces are stored once in the shared folder, as are the
    packed ones of each round: rows of numbers, never texts.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    todo = settle(pieces.select(*kept), "pieces")
    at = kept.index(length)
    schema = T.StructType([*todo.schema.fields]).add("shard", "long").add("sequence", "long").add("offset", "long").add("gap", "long")

    def pack_shard(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(length, "descending"), *((c, "ascending") for c in kept if c != length and not pa.types.is_nested(rows.schema.field(c).type))])
        lengths = rows.column(at).to_numpy()
        return _with(rows, zip(("sequence", "offset", "gap"), sum_of_squares(lengths.astype("i8"), capacity)))

    shards = max(1, -(-todo.count() // SHARD))
    done: list[DataFrame] = []
    before, held = None, None  # sequences that are packed again, and their pieces as they were placed
    for turn in range(ROUNDS):
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64(F.lit(turn), *kept), F.lit(shards)))
        packed = settle(dealt.groupBy("shard").applyInArrow(pack_shard, schema), "packed")
        sequence_id = (
            F.lit(turn << ROUND_BIT).bitwiseOR(F.shiftleft("shard", BIN_BITS)).bitwiseOR(F.col("sequence")).alias("sequence_id")
        )
        drop(todo) if turn == 0 else None
        if before is not None and packed.where("offset = 0").count() >= before:
            done.append(held)
            break
        if shards == 1 or turn == ROUNDS - 1:
            done.append(packed.select(*kept, sequence_id, "offset"))
            break
        poor = F.col("gap") > int(capacity * EMPTY)
        done.append(packed.where(~poor).select(*kept, sequence_id, "offset"))
        held, todo = packed.where(poor).select(*kept, sequence_id, "offset"), packed.where(poor).select(*kept)
        left, before = packed.where(poor).agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if not left:
            break
        shards = max(-(-left // SHARD), -(-shards // TOGETHER))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def _with(rows: pa.Table, columns: Iterator[tuple[str, np.ndarray]]) -> pa.Table:
    for name, values in columns:
        rows = rows.append_column(name, pa.array(values))
    return rows
