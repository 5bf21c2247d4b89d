"""Lines that repeat across documents, counted behind sharded minimal perfect hashes.

The distinct lines, as hashes, are dealt to shards. A shard's hashes become a minimal perfect
hash: levels of bits, where a hash that no other one meets at its place sets a bit and the others
go on to the next level; the number of bits before a set one is the hash's index. Arrays by
index hold a fingerprint, a count and, for lines of several documents, the first document. Documents
probe these arrays with the hashes of their lines; texts of lines are never shuffled or joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.bpe import slices
from salesmart.llm.stored import drop, settle
from salesmart.llm.words import LOWER, mix

WHITE = b" \t\n\x0b\x0c\r"
LEAST = 10  # code points of a line that counts
SHARD = 1 << 16  # hashes of a shard, about
PROBES = 1 << 18  # most probes that one task answers at once, about
SPARSE = 2  # places of a level for each hash that comes to it
FEW = 100_000  # most rows of a table that is broadcast

_STEP = 0x9E3779B97F4A7C15


def line_key(line: bytes) -> bytes:
    """What a line is compared by, from its bytes already in lower case: empty if it is too short to count."""
    key = line.strip(WHITE)
    if len(key) >= 4 * LEAST or (len(key) >= LEAST and len(key) - sum(0x80 <= b < 0xC0 for b in key) >= LEAST):
        return key
    return b""


def line_hashes(text: bytes) -> list[bytes]:
    """A 16-byte hash per line, empty for lines that don't count."""
    return [xxhash.xxh3_128_digest(key) if (key := line_key(line)) else b"" for line in text.translate(LOWER).split(b"\n")]


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * _STEP % 2**64)
    return (mix(a + mix(b + seed)) % np.uint64(size)).astype("i8")


def perfect_hash(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Levels of bits for distinct pairs of 64-bit numbers."""
    levels = []
    while len(a):
        size = SPARSE * len(a)
        at = _place(a, b, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = ~alone[at]
        a, b = a[left], b[left]
    return levels


def indexes(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The index of each pair, from 0 to the number of pairs without gaps; -1 for some of those never put in."""
    out = np.full(len(a), -1, "i8")
    todo, base = np.arange(len(a)), 0
    for level, bits in enumerate(levels):
        at = _place(a[todo], b[todo], level, len(bits))
        hit = bits[at]
        before = np.cumsum(bits, dtype="i8")
        out[todo[hit]] = base + before[at[hit]] - 1
        base += int(before[-1])
        todo = todo[~hit]
    return out


_ARRAYS = "shard int, pieces int, keys int, sizes binary, bits binary, prints binary, counts binary, firsts binary"


def _build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """One shard's arrays: fingerprints of 32 bits, counts of 16 (the largest means itself or more), first documents of repeated lines."""
    a, b = (rows.column(c).to_numpy().view("u8") for c in ("a", "b"))
    n, first = (rows.column(c).to_numpy() for c in ("n", "first"))
    levels = perfect_hash(a, b)
    order = np.argsort(indexes(levels, a, b))
    n, first = n[order], first[order]
    parts = [
        np.array([len(x) for x in levels], "i8"),
        np.packbits(np.concatenate(levels)),
        (b[order] >> np.uint64(32)).astype("u4"),
        np.minimum(n, 0xFFFF).astype("u2"),
        first[n > 1].astype("i8"),
    ]
    pieces = -(-int(n.sum()) // PROBES)
    columns = [pa.array([key[0].as_py()], pa.int32()), pa.array([pieces], pa.int32()), pa.array([len(a)], pa.int32())]
    return pa.Table.from_arrays([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in parts)], [f.split()[0] for f in _ARRAYS.split(", ")])


class Shard:
    """A shard's arrays, opened for probing."""

    def __init__(self, row: dict) -> None:
        sizes = np.frombuffer(row["sizes"], "i8")
        bits = np.unpackbits(np.frombuffer(row["bits"], "u1"), count=int(sizes.sum())).astype(bool)
        self.levels = np.split(bits, np.cumsum(sizes)[:-1])
        self.prints = np.frombuffer(row["prints"], "u4")
        self.counts = np.frombuffer(row["counts"], "u2")
        self.firsts = np.frombuffer(row["firsts"], "i8")
        self.repeated = np.cumsum(self.counts > 1) - 1  # place among the first documents

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each line, 0 for lines that no document has, and the first document where it is over 1."""
        at = indexes(self.levels, a, b)
        known = at >= 0
        known[known] = self.prints[at[known]] == (b[known] >> np.uint64(32)).astype("u4")
        count = np.where(known, self.counts[at], 0)
        first = np.zeros(len(a), "i8")
        many = count > 1
        first[many] = self.firsts[self.repeated[at[many]]]
        return count, first


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Columns ``doc``, ``a``, ``b``: the distinct hashes of each text's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1):
            found = [dict.fromkeys(line_hashes(t or b"")) for t in some.column(1).cast(pa.binary()).to_pylist()]
            for one in found:
                one.pop(b"", None)
            pairs = np.frombuffer(b"".join(b"".join(one) for one in found), "i8").reshape(-1, 2)
            doc = np.repeat(some.column(0).to_numpy(zero_copy_only=False), [len(one) for one in found])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc", "a", "b"])

    known = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), text)
    return known.mapInArrow(run, "doc bigint, a bigint, b bigint")


def build(hashed: DataFrame) -> tuple[DataFrame, int]:
    """A stored row of arrays per shard, and the number of shards; the driver gets no more than a count."""
    lines = settle(hashed.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc").alias("first")), "lines")
    shards = max(1, -(-lines.count() // SHARD))
    arrays = settle(lines.groupBy(_shard(shards)).applyInArrow(_build, _ARRAYS), "arrays")
    drop(lines)
    return arrays, shards


def _shard(shards: int):
    return F.pmod(F.shiftrightunsigned("a", 20), F.lit(shards)).cast("int").alias("shard")


def _spread(probes: DataFrame, arrays: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Probes and arrays by ``shard`` and ``piece``: a shard with many probes is answered in several tasks."""
    hot = arrays.where("pieces > 1").select("shard", "pieces")
    dealt = probes.withColumn("shard", _shard(shards))
    hot = F.broadcast(hot) if hot.count() <= FEW else hot
    dealt = dealt.join(hot, "shard", "left").withColumn("piece", F.pmod(F.xxhash64("doc"), F.coalesce("pieces", F.lit(1))).cast("int"))
    copies = arrays.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest("pieces", F.lit(1)) - 1)))
    return dealt.select("shard", "piece", "doc", "a", "b"), copies


def _repeats(probes: pa.Table, arrays: pa.Table) -> pa.Table:
    """Lines that an earlier document has; a line whose count says that it is repeated, but whose first document is its own, stays."""
    doc, a, b = (probes.column(c).to_numpy() for c in ("doc", "a", "b"))
    if not len(doc):
        gone = np.zeros(0, bool)
    else:
        count, first = Shard(arrays.to_pylist()[0]).probe(a.view("u8"), b.view("u8"))
        gone = (count > 1) & (first != doc)
    return pa.table({"doc": doc[gone], "a": a[gone], "b": b[gone]})


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept``, ``n_lines`` and ``n_dropped``: lines of several documents stay only in the first one.

    A line is compared without white space at its ends and with A-Z in lower case; lines of under
    ten code points stay everywhere. The first document is the one with the smallest number; there
    all copies stay. A null or empty text is one empty line, kept as an empty text. Rows with one
    number are one document and each keep what it keeps; rows without a number keep all lines
    and count for no other row. Texts are handled whole, one at a time; existing columns of the
    added names are replaced. An empty table gives an empty one.
    """
    added = ["kept", "n_lines", "n_dropped"]
    names = [c for c in docs.columns if c not in added]
    hashed = settle(_hashed(docs, key, text), "hashed")
    arrays, shards = build(hashed)
    probes, copies = _spread(hashed, arrays, shards)
    found = probes.groupBy("shard", "piece").cogroup(copies.groupBy("shard", "piece")).applyInArrow(_repeats, "doc bigint, a bigint, b bigint")
    gone = found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("a", "b")).alias("_gone"))
    gone = settle(gone, "gone")
    drop(hashed)
    at = names.index(text)
    rows = docs.select(*names).join(gone, F.col(key).cast("long") == F.col("_doc"), "left").select(*names, "_gone")
    schema = T.StructType([*docs.select(*names).schema.fields]).add("kept", "string").add("n_lines", "long").add("n_dropped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, at):
            whole = pc.fill_null(some.column(at), "")
            n_lines = pc.add(pc.count_substring(whole, "\n"), 1).cast(pa.int64())
            lists = some.column(len(names))
            touched = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            n_dropped = np.zeros(len(some), "i8")
            if len(touched):
                texts = whole.cast(pa.binary()).to_pylist()
                for i in touched:
                    bad = _digests(lists[i].values)
                    lines = texts[i].split(b"\n")
                    left = [line for line, h in zip(lines, line_hashes(texts[i])) if h not in bad]
                    n_dropped[i] = len(lines) - len(left)
                    texts[i] = b"\n".join(left)
                whole = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], whole, n_lines, pa.array(n_dropped)], [*names, *added])

    return rows.mapInArrow(run, schema)


def _digests(pairs: pa.StructArray) -> set[bytes]:
    data = np.stack([pairs.field("a").to_numpy(), pairs.field("b").to_numpy()], axis=1).astype("<i8").tobytes()
    return {data[i : i + 16] for i in range(0, len(data), 16)}
