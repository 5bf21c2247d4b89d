"""Near-duplicate documents by b-bit MinHash, confirmed on their full sets of shingles.

Of each hash function's minimum only a few bits are kept for estimates; bands of full
minima only make bucket numbers. Documents with equal sets are one representative from the
start. In each bucket all members are first compared with its smallest; members of
different components that remain are compared with each other in blocks, by longer
signatures that are made for them alone. A pair whose estimate, corrected for chance
collisions of the bits, is within reach of the threshold is confirmed or refuted on the
whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.bpe import slices
from salesmart.llm.components import components
from salesmart.llm.stored import settle
from salesmart.llm.words import LOWER, hash_runs, hash_words, mix

WORDS = 5
PERCENT = 75
BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
LONGS = HASHES * BITS // 64
FINE, FINE_BITS = 1024, 2  # hash functions and bits kept where members of a bucket meet each other
DEVIATIONS = 4.5  # by which an estimate may fall short of the threshold
BLOCK = 1024  # members of a bucket compared with each other in one go

_MULTIPLY = np.random.default_rng(7).integers(0, 2**63, HASHES, dtype="u8") * np.uint64(2) + np.uint64(1)
_FINE = np.random.default_rng(8).integers(0, 2**63, FINE, dtype="u8") * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """The set of a document's shingles as sorted hashes; a shorter document is one shingle."""
    if not len(words):
        return words
    return np.unique(hash_runs(words, min(WORDS, len(words))))


def minima(found: np.ndarray, functions: np.ndarray = _MULTIPLY) -> np.ndarray:
    """The smallest value of each hash function over a set, as 32-bit numbers."""
    out = np.full(len(functions), 2**32 - 1, "u8")
    for at in range(0, len(found), 4096):
        some = found[at : at + 4096]
        for k in range(0, len(functions), 16):
            least = (some[None, :] * functions[k : k + 16, None]).min(axis=1) >> np.uint64(32)
            np.minimum(out[k : k + 16], least, out=out[k : k + 16])
    return out


def pack_bits(least: np.ndarray, bits: int) -> np.ndarray:
    """The lowest bits of the minima, side by side in 64-bit numbers."""
    low = (least & np.uint64(2**bits - 1)).reshape(len(least) * bits // 64, -1)
    return (low << (np.arange(low.shape[1], dtype="u8") * np.uint64(bits))).sum(axis=1, dtype="u8")


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    words, counts = hash_words([(t or "").encode().translate(LOWER) for t in texts])
    ends = np.cumsum(counts)
    for start, end in zip([0, *ends], ends):
        yield shingles(words[start:end])


def sign(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its number of shingles, two digests of the set, bucket numbers and packed bits."""
    number = docs.select(key).schema[0].dataType.simpleString()
    longs = ", ".join(f"s{i} bigint" for i in range(LONGS))
    schema = f"doc_id {number}, n_shingles bigint, d0 bigint, d1 bigint, buckets array<bigint>, {longs}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1, 1 << 20):
            sizes, digests, buckets, bits = [], [], [], []
            for found in _sets(some.column(1).to_pylist()):
                sizes.append(len(found))
                digests.append((found.sum(dtype="u8"), mix(found).sum(dtype="u8")))
                least = minima(found)
                band = np.arange(BANDS, dtype="u8")
                for k in range(ROWS):
                    band = mix(band * np.uint64(0x100000001B3) + least[k::ROWS])
                buckets.append(band if len(found) else band[:0])
                bits.append(pack_bits(least, BITS))
            ends = np.cumsum([0, *map(len, buckets)]).astype("i4")
            d0, d1 = np.array(digests, "u8").view("i8").T
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(np.array(sizes, "i8")), pa.array(d0), pa.array(d1),
                 pa.ListArray.from_arrays(ends, np.concatenate(buckets).view("i8")), *map(pa.array, np.array(bits, "u8").view("i8").T)],
                ["doc_id", "n_shingles", "d0", "d1", "buckets", *(f"s{i}" for i in range(LONGS))],
            )

    return docs.select(key, text).mapInArrow(run, schema)


def least_matches(percent: int, hashes: int = HASHES, bits: int = BITS) -> int:
    """Matching hash functions below which a pair at the threshold is next to impossible.

    The bits of different minima agree by chance once in ``2**bits``, so the share of
    matches is ``chance + (1 - chance) * similarity``.
    """
    chance = 2.0**-bits
    agree = chance + (1 - chance) * percent / 100
    return int(hashes * agree - DEVIATIONS * (hashes * agree * (1 - agree)) ** 0.5)


def matches(left: list[Column], right: list[Column]) -> Column:
    """In how many hash functions the kept bits agree."""
    nibbles = F.lit(0x1111111111111111)
    differ = []
    for a, b in zip(left, right):
        x = a.bitwiseXOR(b)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ.append(F.bit_count(x.bitwiseAND(nibbles)))
    return F.lit(HASHES) - reduce(lambda p, q: p + q, differ)


def _similar_sizes(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _estimated(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose sizes and kept bits are within reach of the threshold."""
    names = ["n_shingles", *(f"s{i}" for i in range(LONGS))]
    for side in ("a", "b"):
        told = signed.select(F.col("doc_id").alias(side), *(F.col(n).alias(f"{side}_{n}") for n in names))
        pairs = pairs.join(told.hint("merge"), side)
    bits = [[F.col(f"{side}_s{i}") for i in range(LONGS)] for side in ("a", "b")]
    near = _similar_sizes(F.col("a_n_shingles"), F.col("b_n_shingles"), percent) & (matches(*bits) >= least_matches(percent))
    return pairs.where(near).select("a", "b")


def _whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The full sets of the documents in ``ids``, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1, 1 << 20):
            found = [*_sets(some.column(1).to_pylist())]
            ends = np.cumsum([0, *map(len, found)]).astype("i4")
            yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, np.concatenate(found).view("i8"))], ["doc_id", "own"])

    return settle(docs.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(run, "doc_id bigint, own array<bigint>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose full sets are similar enough.

    Both sides grow with the documents, so the joins here and above are merge joins at every size.
    """
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("own").alias("b_own")).hint("merge"), "b")
    both = both.join(sets.select(F.col("doc_id").alias("a"), F.col("own").alias("a_own")).hint("merge"), "a")
    both = both.withColumn("common", F.size(F.array_intersect("a_own", "b_own")))
    either = F.size("a_own") + F.size("b_own") - F.col("common")
    return both.where(F.col("common") * 100 >= either * percent).select("a", "b")


def _fine(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents in ``ids`` with longer signatures, made from their stored sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1)
            flat = own.flatten().to_numpy().view("u8")
            ends = np.cumsum([0, *np.diff(own.offsets.to_numpy())])
            fine = [pack_bits(minima(flat[i:j], _FINE), FINE_BITS).tobytes() for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fine, pa.binary())], ["doc_id", "set", "fine"])

    wanted = sets.join(ids.hint("merge"), "doc_id", "left_semi").select("doc_id", F.col("own").alias("set"))
    return wanted.mapInArrow(run, "doc_id bigint, set array<bigint>, fine binary")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that are in different components.

    ``members``: bucket, component, doc_id, n_shingles, ``fine`` bits, the ``set``, and the
    bucket's ``size``. A large bucket is cut into blocks; each pair of blocks is compared on
    its own, and pairs within reach by their bits are confirmed on their sets at once, so that
    only links leave a task.
    """
    most = FINE - least_matches(percent, FINE, FINE_BITS)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "component", "fine", "set")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc_id")
    low = np.uint64(0x5555555555555555)

    def compare(rows: dict[str, np.ndarray]) -> tuple[list[int], list[int]]:
        component, ids = rows["component"], rows["doc_id"]
        left, right = np.flatnonzero(rows["own"] == rows["i"]), np.flatnonzero(rows["own"] == rows["j"])
        found_a: list[int] = []
        found_b: list[int] = []
        if not len(left) or not len(right) or (component == component[0]).all():
            return found_a, found_b
        sets = [x.view("u8") for x in rows["set"]]
        n = np.array([len(x) for x in sets])
        bits = np.frombuffer(b"".join(rows["fine"]), "u8").reshape(len(ids), -1)
        against = bits[right].T.copy()
        for one in left:
            sizes = np.minimum(n[right], n[one]) * 100 >= np.maximum(n[right], n[one]) * percent
            near = np.flatnonzero((component[right] != component[one]) & sizes)
            if not len(near):
                continue
            x = against[:, near] ^ bits[one][:, None]
            x = (x | (x >> np.uint64(1))) & low
            for other in right[near[np.bitwise_count(x).sum(axis=0, dtype="i4") <= most]]:
                common = _common(sets[one], sets[other])
                if common * 100 >= (n[one] + n[other] - common) * percent:
                    found_a.append(int(min(ids[one], ids[other])))
                    found_b.append(int(max(ids[one], ids[other])))
        return found_a, found_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["bucket", "i", "j"]):
            a, b = compare(rows)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal keys in rows without nulls, as arrays; a run may span batches."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        rows = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns)}
        if held is not None:
            rows = {n: np.concatenate([held[n], rows[n]]) for n in rows}
        n = len(rows[keys[0]])
        new = np.zeros(n, bool)
        for k in keys:
            new[1:] |= rows[k][1:] != rows[k][:-1]
        edges = [0, *np.flatnonzero(new)]
        for start, end in zip(edges, edges[1:]):
            yield {k: v[start:end] for k, v in rows.items()}
        held = {k: v[edges[-1] :] for k, v in rows.items()} if n else None
    if held is not None:
        yield held


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per document ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked where ``100 * intersection >= percent * union`` of their sets of
    five-word shingles; ``component_id`` is the smallest number reachable over links. Null
    and empty texts have no shingles and no links. The key is a whole number; rows of one
    number are taken as one document each and share a component if their texts do, and a
    null number gets a null component. Two similar documents
    are missed only if they share none of the buckets or their estimate falls short by more
    than the allowed deviations: under 1 in 100,000 at the threshold, less above it.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = settle(sign(docs), "signed")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    names = ["n_shingles", "buckets", *(f"s{i}" for i in range(LONGS))]
    same = settle(
        known.groupBy("d0", "d1", "n_shingles").agg(F.min("doc_id").alias("doc_id"), *(F.first(n).alias(n) for n in names if n != "n_shingles")),
        "representatives",
    )
    dealt = same.select("doc_id", F.explode("buckets").alias("bucket"))
    hubs = dealt.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count("*").alias("size")).where("size > 1")
    hubs = settle(hubs, "hubs")
    met = settle(dealt.join(hubs, "bucket").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "met")
    sets = _whole_sets(docs, met.select(F.col("a").alias("doc_id")).unionAll(met.select(F.col("b").alias("doc_id"))).distinct())
    pairs = settle(_estimated(met, same, percent), "pairs")
    links = settle(_confirmed(pairs, sets, percent), "links")
    tied = components(links).withColumnRenamed("node", "doc_id")
    labelled = same.join(tied, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = labelled.select("component", F.explode("buckets").alias("bucket"), "doc_id", "n_shingles")
    mixed = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = settle(mixed.where("lo <> hi").select("bucket", "size"), "mixed")
    members = settle(placed.join(mixed, "bucket"), "members")
    fine = _fine(sets, members.select("doc_id").distinct())
    more = settle(_across(members.join(fine.hint("merge"), "doc_id"), percent), "links")
    tied = components(links.unionAll(more)).withColumnRenamed("node", "doc_id")
    label = same.select("d0", "d1", "n_shingles", "doc_id").join(tied, "doc_id", "left")
    label = label.select("d0", "d1", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "d0", "d1").join(label, ["d0", "d1", "n_shingles"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
