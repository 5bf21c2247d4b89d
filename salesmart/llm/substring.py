"""Removal of repeated word windows, found by backward search in compressed FM-indexes.

Each shard's segments become one sequence of word numbers with an FM-index: the
Burrows-Wheeler transform in a wavelet matrix of packed bits with counts. Every segment is
streamed through it from its last word to its first; the match is capped at the window's
length, and each interval of that depth tells in how early a document its words start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.bpe import slices
from salesmart.llm.repeats import Kind, covered, repeated, runs_of
from salesmart.llm.words import hash_runs, hash_words

WINDOW = 50
GRAM = 12
SHARD = 1_000_000  # words of an index, about
SPACED = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


class Wavelet:
    """Ranks of symbols in a sequence; one row of packed bits per bit of a symbol, highest first."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level) & 1 == 1
            padded = np.zeros((len(bit) // 64 + 1) * 64, bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype="i4")[:-1]].astype("i4"))
            self.zeros.append(len(bit) - int(bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])
        self.base = self._walk(np.arange(symbols), np.zeros(symbols, "i8"))

    def _walk(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for words, counts, zeros, level in zip(self.bits, self.counts, self.zeros, range(self.levels - 1, -1, -1)):
            at = place >> 6
            mask = (np.uint64(1) << (place & 63).astype("u8")) - np.uint64(1)
            ones = counts[at] + np.bitwise_count(words[at] & mask)
            place = np.where((symbol >> level) & 1 == 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbol, place) - self.base[symbol]


def dense_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` symbols, equal ones alike; past the end come zeros."""
    n = len(text)
    bits = max(1, int(text.max(initial=1)).bit_length())
    reach = max(1, min(depth, 62 // bits))
    key = np.zeros(n, "i8")
    for k in range(reach):
        key <<= bits
        key[: n - k] |= text[k:]
    rank = np.unique(key, return_inverse=True)[1]
    while reach < depth:
        step = min(reach, depth - reach)  # the second half may overlap the first, where both are equal
        follow = np.zeros(n, "i8")
        follow[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + follow, return_inverse=True)[1]
        reach += step
    return rank


class FMIndex:
    """Of a sequence of numbers from 0, suffixes sorted by their first ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.depth = depth
        rank = dense_ranks(text, depth)
        self.order = np.argsort(rank, kind="stable")
        self.block = rank[self.order]  # of suffixes that agree in ``depth`` symbols
        self.first = np.flatnonzero(np.r_[True, self.block[1:] != self.block[:-1]])
        self.last = np.r_[self.first[1:], len(text)]
        symbols = int(text.max()) + 1
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))][:symbols]
        self.wavelet = Wavelet(text[self.order - 1], symbols)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more symbol on their left."""
        both = self.wavelet.rank(np.r_[symbol, symbol], np.r_[low, high])
        start = self.before[symbol]
        return start + both[: len(symbol)], start + both[len(symbol) :]

    def cap(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``depth`` symbols of longer matches."""
        block = self.block[low]
        return self.first[block], self.last[block]


def search(doc: np.ndarray, start: np.ndarray, n: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the segments that also start in a smaller document of the shard."""
    hashes, counts = hash_words(contents)
    known, numbers = np.unique(hashes, return_inverse=True)
    ends = np.cumsum(counts + 1)
    text = np.zeros(int(ends[-1]), "i8")  # 0 ends a segment
    segment = np.repeat(np.arange(len(counts)), counts)
    text[np.arange(len(hashes)) + segment] = numbers + 1
    index = FMIndex(text, WINDOW)
    owner = np.repeat(np.unique(doc, return_inverse=True)[1], counts + 1)
    smallest = np.minimum.reduceat(owner[index.order], index.first)

    by_size = np.argsort(-counts, kind="stable")
    place = ends[by_size] - 2  # the last word of each
    size = counts[by_size]
    low, high, length = np.zeros(len(place), "i8"), np.full(len(place), len(text)), np.zeros(len(place), "i8")
    flags = np.zeros(len(text), bool)
    for step in range(int(size[0])):
        live = int(np.searchsorted(-size, -step, side="left"))
        at = place[:live] - step
        a, b = index.extend(text[at], low[:live], high[:live])
        length[:live] += 1
        full = length[:live] >= WINDOW
        a[full], b[full] = index.cap(a[full])
        low[:live], high[:live] = a, b
        hit = at[full]
        flags[hit] = smallest[index.block[a[full]]] < owner[hit]
    begins = ends - counts - 1
    first, last = runs_of(flags, begins)
    of = np.searchsorted(ends, first, side="right")
    return doc[of], start[of] + first - begins[of], start[of] + last - begins[of]


def _contents(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[start : start + size]) for start, size in spans]


KIND = Kind(WINDOW, GRAM, False, SHARD, hash_words, hash_runs, lambda words: words, _contents)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", spaced: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept``: the words no repeated window covers, joined by a space.

    ``spaced`` keeps the white space after each word that stays, and texts that lose nothing as they are.

    A window of 50 words is repeated if it also starts in a document with a smaller number.
    Null and empty texts have no words and an empty ``kept``; rows of one number are taken
    as copies of one text, and rows without a number keep their words. Existing columns of
    these names are replaced.
    """
    added = ["n_words", "n_removed", "kept"]
    names = [c for c in docs.columns if c not in (*added, "runs")]
    docs = docs.select(*names)
    numbered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = repeated(numbered, KIND, search).withColumnRenamed("doc_id", "_number")
    joined = docs.join(found.hint("merge"), docs[key].cast("long") == found["_number"], "left").select(*names, "runs")
    schema = T.StructType([*docs.schema.fields]).add("n_words", "long").add("n_removed", "long").add("kept", "string")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, at):
            rows = []
            for value, runs in zip(some.column(at).to_pylist(), some.column(len(names)).to_pylist()):
                words = (value or "").encode().split()
                gone = covered(runs, len(words), WINDOW) if runs else None
                left = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
                if spaced and len(left) == len(words):
                    kept = value or ""
                elif spaced:
                    kept = b"".join(w for w, g in zip(SPACED.findall(value.encode()), gone.tolist()) if not g).decode()
                else:
                    kept = b" ".join(left).decode()
                rows.append((len(words), len(words) - len(left), kept))
            yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string())))], [*names, *added])

    return joined.mapInArrow(run, schema)
