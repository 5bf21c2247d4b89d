"""Windows that also start earlier, over a whole corpus: what both substring operators share.

Windows of a fixed number of symbols are gathered into segments by their smallest gram
(``anchors``). Segments whose key stands nowhere else hold no repeated window. Of the rest,
equal segments become one, kept by its earliest occurrence; all others are repeated as a
whole. Different segments of one key go to one shard, whose index tells which of their
windows start earlier in another segment. A key with very many different segments is cut
into single windows, which are grouped by their content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.anchors import segments
from salesmart.llm.bpe import slices
from salesmart.llm.stored import drop, settle
from salesmart.llm.words import mix, powers

LIMIT = 1 << 20  # symbols handled at once
HOT = 20_000  # different segments of one key beyond which they are cut into windows

# From a shard's segments to repeated windows: documents, starts, numbers of windows and contents of the
# segments; back come documents and first and last repeated windows.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Kind:
    """How texts become symbols. All functions see UTF-8 bytes."""

    window: int
    gram: int
    within: bool  # whether earlier places of the same document count
    shard: int  # symbols of a shard, about
    symbols: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]  # of all texts, and their numbers
    grams: Callable[[np.ndarray, int], np.ndarray]
    hashes: Callable[[np.ndarray], np.ndarray]
    contents: Callable[[bytes, list[tuple[int, int]]], list[bytes]]  # of a text from a symbol on, so many


def _goes(symbols: np.ndarray, counts: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols in goes of bounded size; long texts in pieces that overlap by a window less one."""
    ends = np.cumsum(counts)
    i = 0
    while i < len(counts):
        begin = int(ends[i] - counts[i])
        if counts[i] > LIMIT:
            step = LIMIT - window + 1
            for at in range(0, int(counts[i]) - window + 1, step):
                piece = symbols[begin + at : begin + min(at + LIMIT, int(counts[i]))]
                yield piece, np.array([len(piece)]), np.array([i]), np.array([at])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, begin + LIMIT, side="right")))
        yield symbols[begin : int(ends[j - 1])], counts[i:j], np.arange(i, j), np.zeros(j - i, "i8")
        i = j


def _keys(docs: DataFrame, kind: Kind) -> DataFrame:
    """Every segment of every text, as far as counting needs: ``key``, ``doc_id``, ``times``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1, LIMIT):
            ids = some.column(0).to_numpy()
            symbols, counts = kind.symbols([(t or "").encode() for t in some.column(1).to_pylist()])
            for go, lengths, owner, _ in _goes(symbols, counts, kind.window):
                place, _, key, times = segments(kind.grams(go, kind.gram), lengths, kind.window, kind.gram)
                if len(place):
                    text = np.searchsorted(np.cumsum(lengths), place, side="right")
                    yield pa.RecordBatch.from_arrays([pa.array(key.view("i8")), pa.array(ids[owner[text]]), pa.array(times.astype("i4"))], ["key", "doc_id", "times"])

    return docs.mapInArrow(run, "key bigint, doc_id bigint, times int")


def _occurrences(docs: DataFrame, kind: Kind) -> DataFrame:
    """Every segment of every text: ``key``, ``digest`` of its content, ``doc_id``, ``start``, ``n`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1, LIMIT):
            ids = some.column(0).to_numpy()
            symbols, counts = kind.symbols([(t or "").encode() for t in some.column(1).to_pylist()])
            for go, lengths, owner, offset in _goes(symbols, counts, kind.window):
                place, n, key, _ = segments(kind.grams(go, kind.gram), lengths, kind.window, kind.gram)
                if not len(place):
                    continue
                hashes = kind.hashes(go)
                ahead, back = powers(len(go) + 1)
                sums = np.zeros(len(go) + 1, "u8")
                np.cumsum(hashes * ahead[:-1], out=sums[1:])
                digest = mix((sums[place + n + kind.window - 1] - sums[place]) * back[place] + n.astype("u8"))
                text = np.searchsorted(np.cumsum(lengths), place, side="right")
                start = place - (np.cumsum(lengths) - lengths)[text] + offset[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view("i8")), pa.array(digest.view("i8")), pa.array(ids[owner[text]]), pa.array(start), pa.array(n.astype("i4"))],
                    ["key", "digest", "doc_id", "start", "n"],
                )

    return docs.mapInArrow(run, "key bigint, digest bigint, doc_id bigint, start bigint, n int")


def _contents(docs: DataFrame, wanted: DataFrame, kind: Kind, single: bool) -> DataFrame:
    """The contents of the wanted segments (``doc_id``, ``start``, ``n``, ``key``), or of each of their windows."""
    schema = "key bigint, doc_id bigint, start bigint, n int" + ("" if single else ", content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1, LIMIT):
            for doc, text, asked in zip(*(c.to_pylist() for c in some.columns)):
                spans = [(a["start"], a["n"]) for a in asked]
                if single:
                    spans = [*dict.fromkeys((s + k, 1) for s, n in spans for k in range(n))]
                found = kind.contents((text or "").encode(), [(s, n + kind.window - 1) for s, n in spans])
                keys = [_digest(x) for x in found] if single else [a["key"] for a in asked]
                columns = [pa.array(keys, pa.int64()), pa.array([doc] * len(spans), pa.int64()), pa.array([s for s, _ in spans], pa.int64()), pa.array([n for _, n in spans], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns if single else [*columns, pa.array(found, pa.binary())], schema.replace(" bigint", "").replace(" int", "").replace(" binary", "").split(", "))

    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "key")).alias("asked"))
    return docs.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(run, schema)


def _digest(content: bytes) -> int:
    return int.from_bytes(blake2b(content, digest_size=8).digest(), "little", signed=True)


def repeated(docs: DataFrame, kind: Kind, search: Search) -> DataFrame:
    """``doc_id``, ``lo`` and ``hi``: runs of windows that also start earlier; ``docs`` has ``doc_id`` (bigint) and ``text``.

    Earlier is a smaller document, or, where the kind says so, a smaller start in the same one.
    Rows of one number are taken as copies of one text. Null numbers, null texts and
    texts shorter than a window have none.
    """
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    several = F.sum("times") > 1 if kind.within else F.min("doc_id") < F.max("doc_id")
    keys = settle(_keys(docs, kind).groupBy("key").agg(several.alias("several")).where("several").select("key"), "keys")
    held = settle(_occurrences(docs, kind).join(keys, "key"), "occurrences")
    drop(keys)
    earliest = F.min(F.struct("doc_id", "start")) if kind.within else F.min(F.struct("doc_id"))
    distinct = settle(held.groupBy("key", "digest").agg(earliest.alias("e")).select("key", "digest", "e.*"), "distinct")
    by = ["key", "digest", "doc_id", "start"] if kind.within else ["key", "digest", "doc_id"]
    first = settle(held.dropDuplicates(["key", "digest", "doc_id", "start"]).join(distinct, by, "left_semi"), "first")
    later = held.join(distinct.select("key", "digest", F.col("doc_id").alias("d"), *([F.col("start").alias("s")] if kind.within else [])), ["key", "digest"])
    later = later.where("doc_id > d or (doc_id = d and start > s)" if kind.within else "doc_id > d")
    whole = later.select("doc_id", F.col("start").alias("lo"), (F.col("start") + F.col("n") - 1).alias("hi"))

    many = distinct.groupBy("key").agg(F.count("*").alias("d"))
    alone = settle(many.where("d = 1").select("key"), "alone") if not kind.within else None
    hot = settle(many.where(F.col("d") > HOT).select("key"), "hot")
    if alone is not None:  # all documents of such a key hold the same segment: nothing is left to look up
        first = first.join(alone, "key", "left_anti")
    normal = first.join(hot, "key", "left_anti")
    size = normal.agg(F.sum(F.col("n") + kind.window - 1)).first()[0] or 0
    shards = max(1, -(-size // kind.shard))
    dealt = _contents(docs, normal, kind, False).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))

    def look(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        doc, lo, hi = search(rows.column("doc_id").to_numpy(), rows.column("start").to_numpy(), rows.column("n").to_numpy().astype("i8"), rows.column("content").to_pylist())
        return pa.table({"doc_id": doc, "lo": lo, "hi": hi})

    looked = dealt.groupBy("shard").applyInArrow(look, "doc_id bigint, lo bigint, hi bigint")
    out = whole.unionAll(looked)
    if not hot.isEmpty():
        windows = _contents(docs, first.join(hot, "key", "left_semi"), kind, True)
        windows = settle(windows, "windows")
        best = windows.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("e"), F.count("*").alias("c")).where("c > 1").select("key", "e.*")
        again = windows.join(best.select("key", F.col("doc_id").alias("d"), F.col("start").alias("s")), "key")
        again = again.where("doc_id > d or (doc_id = d and start > s)" if kind.within else "doc_id > d")
        out = out.unionAll(again.select("doc_id", F.col("start").alias("lo"), F.col("start").alias("hi")))
    return settle(out.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "runs")


def runs_of(flags: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of true flags; a run ends where a segment does."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[begins] = True
    before = np.r_[False, flags[:-1]] & ~edge[:-1]
    first = np.flatnonzero(flags & ~before)
    after = np.r_[flags[1:], False] & ~edge[1:]
    return first, np.flatnonzero(flags & ~after)


def covered(runs: list[dict[str, int]], size: int, window: int) -> np.ndarray:
    """Which symbols the windows of the runs cover."""
    steps = np.zeros(size + 1, "i8")
    for run in runs:
        steps[run["lo"]] += 1
        steps[min(size, run["hi"] + window)] -= 1
    return np.cumsum(steps[:-1]) > 0
