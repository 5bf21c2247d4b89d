"""Removal of repeated byte strings, by suffix order from prefix-free parsing.

The segments of a shard are cut into phrases wherever a rolling hash of a few bytes
triggers; a phrase ends with the next one's trigger, so no phrase suffix is a prefix of
another. Only the different phrases (the dictionary) and the sequence of phrase numbers
(the parse) are sorted: a place's rank in the whole text is the rank of its phrase suffix,
then the rank of the parse after it. Equal strings of the window's length are neighbours
in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.llm.bpe import slices
from salesmart.llm.repeats import Kind, covered, repeated, runs_of
from salesmart.llm.words import mix, powers, prefix_sums

WINDOW = 100
GRAM = 28
SHARD = 2_000_000  # bytes of an index, about; a task takes some 110 bytes of memory for each
TRIGGER, ONE_IN = 6, 16  # bytes of a trigger, and how many places have one on average


def _rolling(data: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
    n = max(0, len(data) - size + 1)
    sums = prefix_sums(data) if sums is None else sums
    return mix((sums[size : size + n] - sums[:n]) * powers(len(data) + 1)[1][:n])


def _parted(rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks the ``live`` ones anew by ``key``, which sorts by rank first; those that are still alike come back."""
    order = np.argsort(key)
    live, key = live[order], key[order]
    own = rank[live]
    group = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], np.arange(len(live)), 0))
    new = np.r_[True, key[1:] != key[:-1]]
    equal = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))
    rank[live] = own + equal - group
    return live[~(new & np.r_[new[1:], True])]


def refine(rank: np.ndarray, reach: int, left: np.ndarray) -> np.ndarray:
    """Ranks of suffixes of strings from the ranks of their first ``reach`` symbols.

    ``rank`` counts the smaller suffixes and ``left`` the symbols to the string's end; the
    end sorts before every symbol. Only suffixes that are still alike and long enough are
    looked at again, over twice the reach each time; those that end just there come first.
    """
    n = len(rank)
    rank = rank.astype("i8")
    live = np.flatnonzero((np.bincount(rank, minlength=n)[rank] > 1) & (left >= reach))
    while len(live):
        follow = np.where(left[live] > reach, rank[np.minimum(live + reach, n - 1)] + 1, 0)
        live = _parted(rank, live, rank[live] * (n + 1) + follow)
        reach *= 2
        live = live[left[live] >= reach]
    return rank


def _first_ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    found = key[order]
    first = np.maximum.accumulate(np.where(np.r_[True, found[1:] != found[:-1]], np.arange(len(key)), 0))
    rank = np.empty(len(key), "i8")
    rank[order] = first
    return rank


def _suffix_ranks(data: np.ndarray, left: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Ranks of the ``wanted`` suffixes among themselves; each ends ``left`` symbols on, and ends sort first.

    As many symbols as a number holds are compared at once; only suffixes that are still alike and
    long enough go on, by their next symbols, so that no other suffix needs a rank.
    """
    used = np.bincount(data, minlength=256) > 0
    base = max(2, int(np.count_nonzero(used)) + 1)
    symbol = np.cumsum(used)[data]

    def fitting(bound: int) -> int:
        """How many symbols fit beside numbers below the bound."""
        count = 1
        while bound * base ** (count + 1) < 1 << 63:
            count += 1
        return count

    packed = fitting(1)
    ahead = np.zeros(len(data), "i8")
    for k in range(packed):
        ahead *= base
        ahead[: len(data) - k] += np.where(left[: len(data) - k] > k, symbol[k:], 0)
    rank = _first_ranks(ahead[wanted])
    step = min(packed, fitting(len(wanted)))
    unit, reach = base ** (packed - step), packed
    live = np.flatnonzero((np.bincount(rank, minlength=len(rank))[rank] > 1) & (left[wanted] >= reach))
    while len(live):
        place = wanted[live]
        follow = np.where(left[place] > reach, ahead[np.minimum(place + reach, len(data) - 1)] // unit, 0)
        live = _parted(rank, live, rank[live] * base**step + follow)
        reach += step
        live = live[left[wanted[live]] >= reach]
    return rank


def _numbered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different name, and the number of each name."""
    order = np.argsort(names)
    new = np.r_[True, names[order[1:]] != names[order[:-1]]]
    number = np.empty(len(names), "i8")
    number[order] = np.cumsum(new) - 1
    return order[new], number


def corpus_order(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``places`` in the order of the suffixes of their texts, by prefix-free parsing of all texts."""
    owner = np.repeat(np.arange(len(begins)), ends - begins)
    sums = prefix_sums(data)
    hit = np.flatnonzero(_rolling(data, TRIGGER, sums) % np.uint64(ONE_IN) == 0)
    hit = hit[(hit + TRIGGER <= ends[owner[hit]]) & (hit > begins[owner[hit]])]
    start = np.sort(np.r_[begins, hit])  # of phrases
    text = owner[start]
    last = np.r_[text[1:] != text[:-1], True]
    stop = np.where(last, ends[text], np.r_[start[1:], 0] + TRIGGER)
    # The dictionary: one place of each different phrase; a text's last phrase ends differently from others.
    name = mix((sums[stop] - sums[start]) * powers(len(data) + 1)[1][start] + (stop - start).astype("u8") * np.uint64(2) + last.astype("u8"))
    example, phrase = _numbered(name)
    size = (stop - start)[example]
    at = np.cumsum(size) - size
    left = np.repeat(at + size, size) - np.arange(int(size.sum()))
    source = np.repeat(start[example], size) + np.arange(len(left)) - np.repeat(at, size)
    of = np.searchsorted(start, places, side="right") - 1
    asked = at[phrase[of]] + places - start[of]
    wanted = np.zeros(len(left), bool)
    wanted[asked] = wanted[at] = True
    suffix = np.zeros(len(left), "i8")
    suffix[wanted] = _suffix_ranks(data[source], left, np.flatnonzero(wanted))
    # The parse: phrase ranks, then ranks of its suffixes.
    rank = suffix[at][phrase]
    follow = refine(_first_ranks(rank), 1, _ahead(last))
    after = np.where(last, 0, np.r_[follow[1:], 0] + 1)
    return np.argsort(suffix[asked] * (len(start) + 2) + after[of])


def _ahead(last: np.ndarray) -> np.ndarray:
    """Number of phrases from each to its text's last, itself included."""
    final = np.flatnonzero(last)
    return final[np.searchsorted(final, np.arange(len(last)))] - np.arange(len(last)) + 1


def search(doc: np.ndarray, start: np.ndarray, n: np.ndarray, contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the segments, sorted by document and start, that also start earlier in the shard."""
    data = np.frombuffer(b"".join(contents), "u1")
    size = n + WINDOW - 1
    ends = np.cumsum(size)
    begins = ends - size
    windows = np.repeat(begins - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    order = corpus_order(data, begins, ends, windows)
    content = _rolling(data, WINDOW)[windows][order]
    block = np.flatnonzero(np.r_[True, content[1:] != content[:-1]])
    # By document, then by the window's own start.
    of = np.repeat(np.arange(len(n)), n)
    place = start[of] + windows - begins[of]
    earlier = np.empty(len(windows), "i8")
    earlier[np.lexsort((place, doc[of]))] = np.arange(len(windows))
    least = np.repeat(np.minimum.reduceat(earlier[order], block), np.diff(np.r_[block, len(order)]))
    # The same place may stand in two segments only if rows repeat; it is not earlier than itself.
    at_least = np.empty(len(windows), "i8")
    at_least[order] = least
    inverse = np.empty(len(windows), "i8")
    inverse[earlier] = np.arange(len(windows))
    first = inverse[at_least]
    flags = (doc[of[first]] < doc[of]) | (place[first] < place)
    lo, hi = runs_of(flags, np.cumsum(n) - n)
    return doc[of[lo]], place[lo], place[hi]


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), "u1"), np.array([len(t) for t in texts], "i8")


def _contents(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    return [text[start : start + size] for start, size in spans]


_HASHES = mix(np.arange(1, 257, dtype="u8"))


def _byte_hashes(data: np.ndarray) -> np.ndarray:
    return _HASHES[data]


KIND = Kind(WINDOW, GRAM, True, SHARD, _symbols, _rolling, _byte_hashes, _contents)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary): the bytes no repeated window covers.

    A string of 100 bytes is repeated if it also starts in a document with a smaller number,
    or earlier in the same one. Null and empty texts have no bytes; rows of one number are
    taken as copies of one text, and rows without a number keep their bytes. Existing
    columns of these names are replaced.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept"]
    names = [c for c in docs.columns if c not in (*added, "runs")]
    docs = docs.select(*names)
    numbered = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = repeated(numbered, KIND, search).withColumnRenamed("doc_id", "_number")
    joined = docs.join(found, docs[key].cast("long") == found["_number"], "left").select(*names, "runs")
    schema = T.StructType([*docs.schema.fields])
    for name, kind in zip(added, ("long", "long", "long", "binary")):
        schema = schema.add(name, kind)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, at):
            rows = []
            for value, runs in zip(some.column(at).to_pylist(), some.column(len(names)).to_pylist()):
                data = (value or "").encode()
                if not runs:
                    rows.append((len(data), 0, 0, data))
                    continue
                gone = covered(runs, len(data), WINDOW)
                spans = int(np.count_nonzero(np.diff(gone, prepend=False) & gone))
                left = np.frombuffer(data, "u1")[~gone].tobytes()
                rows.append((len(data), len(data) - len(left), spans, left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], [*names, *added])

    return joined.mapInArrow(run, schema)
