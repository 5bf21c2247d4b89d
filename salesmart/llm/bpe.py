"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its inverse.

Where a merge list is proper (every operand is a byte or the product of an earlier
rule), merges happen in the order of their ranks. Text that follows a prefix can then
change the prefix's tokens only through a chain of rules of rising rank, each taking one
more token on the left of the changed region. The longest such chain, in bytes, is the
list's sufficient lookahead: tokens that end further than that from the end of what has
been read are final, whatever follows. So the transducer holds one window of bytes,
however long a word is.
"""

from __future__ import annotations

import codecs
import ctypes
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pattern by which byte-level BPE splits text into words.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# A space between two other white spaces belongs to a longer run; elsewhere words end before every space.
INNER_SPACE = re.compile(r"\s \s|\s \Z")
CUT = re.compile(r"\S(?= \S)")

BLOCK = 1 << 20  # characters of a long text handled at once
KNOWN = 300_000  # words whose tokens a worker remembers, twice at most
SHORT = 48  # bytes of a piece that is merged together with others


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by the published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """How many bytes of text before its end a continuation can still regroup.

    A chain's next rule has a higher rank, and its right operand begins with the left
    operand of the rule before, because that token starts where the changed region starts.
    """
    made: set[bytes] = set()
    reach: dict[bytes, int] = {}  # left operand -> longest chain that ends by taking it
    for left, right in merges:
        if any(len(x) > 1 and x not in made for x in (left, right)):
            raise ValueError("the merge list is not proper: a rule uses a token before it is made")
        made.add(left + right)
        longest = max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        reach[left] = max(reach.get(left, 0), len(left) + longest)
    return max(reach.values(), default=0)


class Transducer:
    """Encodes one stream of bytes without word limits; ``feed`` returns tokens once they are final."""

    def __init__(self, vocabulary: "Vocabulary") -> None:
        self.vocabulary = vocabulary
        self.held = b""

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        final: list[int] = []
        while len(self.held) >= self.vocabulary.window:
            head = self.held[: self.vocabulary.window]
            end, stable = 0, len(head) - self.vocabulary.lookahead
            for token in self.vocabulary.merge(head):
                if end + len(self.vocabulary.text_of[token]) > stable:
                    break
                end += len(self.vocabulary.text_of[token])
                final.append(token)
            self.held = self.held[end:]
        return final

    def finish(self) -> list[int]:
        rest, self.held = self.vocabulary.merge(self.held), b""
        return rest


class _Ranks:
    """Ranks of pairs for whole arrays: hash tables without chains, each holding what the one before could not."""

    def __init__(self, rank: dict[int, int], never: int) -> None:
        keys, values = np.fromiter(rank, "u8", len(rank)), np.fromiter(rank.values(), "i4", len(rank))
        self.never, self.tables, multiplier = never, [], 0x9E3779B97F4A7C15
        while len(keys):
            bits = max(4, int(4 * len(keys)).bit_length())
            slot = (keys * np.uint64(multiplier)) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            held, at = np.full(1 << bits, 2**64 - 1, "u8"), np.full(1 << bits, never, "i4")
            held[slot[first]], at[slot[first]] = keys[first], values[first]
            self.tables.append((np.uint64(multiplier), np.uint64(64 - bits), held, at))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, multiplier = keys[left], values[left], (multiplier * 0xD1342543DE82EF95 + 2) % 2**64 | 1

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), self.never, "i4")
        for multiplier, shift, held, at in self.tables:
            slot = (keys * multiplier) >> shift
            np.copyto(found, at[slot], where=held[slot] == keys)
        return found


class Vocabulary:
    """A byte-level BPE vocabulary file: encoder, decoder and its lookahead."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, letters = told["model"], byte_letters()
        parts = told.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or parts.get("type") != "ByteLevel" or parts.get("add_prefix_space") or told.get("normalizer"):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        self.special = {a["content"]: a["id"] for a in told.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.text_of: list[bytes] = [b""] * size
        for token, i in ids.items():
            if token not in self.special:
                self.text_of[i] = raw(token)
        for token, i in self.special.items():
            self.text_of[i] = token.encode()
        self.byte_id = [0] * 256
        for letter, byte in letters.items():
            self.byte_id[byte] = ids[letter]
        self.shift = size.bit_length()
        self.rank = {(ids[a] << self.shift) | ids[b]: r for r, (a, b) in enumerate(merges)}
        self.product = [ids[a + b] for a, b in merges]
        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in merges])
        self.window = 2 * (self.lookahead + max(map(len, self.text_of)))
        self.ranks = _Ranks(self.rank, len(self.product))
        self.products = np.array([*self.product, -1], "i8")
        self.byte_ids = np.array(self.byte_id, "i8")
        self.known: dict[str, bytes] = {}  # tokens of a word, as little-endian 32-bit numbers; two generations bound it
        self.older: dict[str, bytes] = {}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of a piece by applying the rules in the order of rank, leftmost first."""
        parts = [self.byte_id[b] for b in piece]
        n, rank, shift = len(parts), self.rank, self.shift
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                pair = (parts[i] << shift) | parts[after[i]]
                if (r := rank.get(pair)) is not None:
                    heapq.heappush(heap, (r, i, pair))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, pair = heapq.heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or (parts[i] << shift) | parts[j] != pair:
                continue
            parts[i], parts[j] = self.product[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [t for t in parts if t >= 0]

    def _merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` for many short pieces at once, one rule a piece and round."""
        size = np.fromiter(map(len, pieces), "i8", len(pieces))
        parts = self.byte_ids[np.frombuffer(b"".join(pieces), "u1")]
        piece = np.repeat(np.arange(len(pieces)), size)
        done_parts, done_piece = [], []
        while len(parts):
            same = np.zeros(len(parts), bool)
            same[:-1] = piece[:-1] == piece[1:]
            rank = np.full(len(parts), self.ranks.never, "i4")
            at = np.flatnonzero(same)
            rank[at] = self.ranks((parts[at].astype("u8") << np.uint64(self.shift)) | parts[at + 1].astype("u8"))
            begins = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            length = np.diff(np.r_[begins, len(parts)])
            least = np.repeat(np.minimum.reduceat(rank, begins), length)
            ended = least == self.ranks.never
            if ended.any():
                done_parts.append(parts[ended])
                done_piece.append(piece[ended])
            hit = np.flatnonzero((rank == least) & ~ended)
            hit = hit[np.r_[True, piece[hit[1:]] != piece[hit[:-1]]]] if len(hit) else hit
            parts[hit] = self.products[rank[hit]]
            ended[hit + 1] = True
            parts, piece = parts[~ended], piece[~ended]
        if not done_parts:
            return [b""] * len(pieces)
        piece, parts = np.concatenate(done_piece), np.concatenate(done_parts)
        order = np.argsort(piece, kind="stable")
        data = parts[order].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(piece, minlength=len(pieces)))).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Tokens of each word of the pattern, whatever its length."""
        pieces = [w.encode() for w in words]
        short = [i for i, x in enumerate(pieces) if len(x) <= SHORT]
        out: list[bytes] = [b""] * len(pieces)
        for i, tokens in zip(short, self._merge_all([pieces[i] for i in short])):
            out[i] = tokens
        for i, piece in enumerate(pieces):
            if len(piece) > SHORT:
                stream, found = Transducer(self), []
                for at in range(0, len(piece), self.window):
                    found += stream.feed(piece[at : at + self.window])
                out[i] = np.array(found + stream.finish(), "<u4").tobytes()
        return out

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        """Tokens of what stands between spaces: with the space before it, or at a text's start if the key ends with one."""
        texts = [k[:-1] if k[-1:] == " " else " " + k for k in keys]
        words: list[str] = []
        counts: list[int] = []
        joined = [i for i, k in enumerate(keys) if not (k.isalpha() or k[-1:] == " " or not k or k[0].isspace() or k[-1].isspace())]
        parts = WORDS.findall("".join(texts[i] for i in joined))  # each begins with a space and ends without: words never span two
        spans = np.searchsorted(np.cumsum([len(p) for p in parts]), np.cumsum([len(texts[i]) for i in joined]), side="left") + 1 if joined else []
        of = {i: parts[a:b] for i, a, b in zip(joined, [0, *spans], spans)}
        for i, (key, text) in enumerate(zip(keys, texts)):
            own = [text] if key.isalpha() else of[i] if i in of else WORDS.findall(text)
            words += own
            counts.append(len(own))
        distinct = dict.fromkeys(words)
        for word, tokens in zip(distinct, self.encode_words([*distinct])):
            distinct[word] = tokens
        found, at = {}, 0
        for key, n in zip(keys, counts):
            found[key] = b"".join(map(distinct.__getitem__, words[at : at + n]))
            at += n
        return found

    def _plain(self, text: str) -> Iterator[list[str] | bytes]:
        """Keys of ``_learn`` for each block of a text, or its tokens where spaces stand among white space."""
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > BLOCK and (cut := CUT.search(text, start + BLOCK)):
                end = cut.end()
            block = text[start:end]
            if INNER_SPACE.search(block):
                yield b"".join(self.encode_words(WORDS.findall(block)))
            else:
                keys = block.split(" ")
                if keys[0]:
                    keys[0] += " "
                    yield keys
                else:
                    yield keys[1:]
            start = end

    def _parts(self, text: str) -> Iterator[list[str] | bytes]:
        start = 0
        for mark in self.split_special.finditer(text) if self.split_special else ():
            yield from self._plain(text[start : mark.start()])
            yield np.array([self.special[mark.group()]], "<u4").tobytes()
            start = mark.end()
        yield from self._plain(text[start:] if start else text)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """All token numbers of each text; strings of special tokens become those tokens."""
        told, lacking, new = [], [], {}
        for text in texts:
            told.append([])
            for keys in self._parts(text):
                if type(keys) is list:
                    tokens = [*map(self.known.get, keys)]
                    if None in tokens:
                        lacking.append((keys, tokens))
                        new |= dict.fromkeys(k for k, v in zip(keys, tokens) if v is None)
                    told[-1].append(tokens)
                else:
                    told[-1].append([keys])
        found = {k: v for k in new if (v := self.older.get(k)) is not None}
        found |= self._learn([k for k in new if k not in found])
        for keys, tokens in lacking:
            tokens[:] = [found[k] if v is None else v for k, v in zip(keys, tokens)]
        out = [np.frombuffer(b"".join([b"".join(p) for p in parts]), "<u4") for parts in told]
        self.known |= {k: v for k, v in found.items() if len(k) <= SHORT}
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of a stream of token numbers; a character is told once its last byte is in.

        Bytes that are no UTF-8 become U+FFFD, one for each maximal part.
        """
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for some in ids:
            yield state.decode(b"".join(map(self.text_of.__getitem__, some.tolist())))
        yield state.decode(b"", final=True)


class Library(Vocabulary):
    """The same file's numbers, found by a tokenizer library: for operators that need numbers, not this method."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        if self.product != sorted(set(self.product)) or max(self.byte_id) > min(self.product):
            raise ValueError(f"{path} doesn't number its tokens in the order of its rules")
        ranks = {self.text_of[i]: i for i in [*self.byte_id, *self.product]}
        pattern = WORDS.pattern.replace(r"\P{White_Space}", r"\S").replace(r"\p{White_Space}", r"\s")
        self.library = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        encode = self.library.encode_ordinary
        return {k: array("I", encode(k[:-1] if k[-1:] == " " else " " + k)).tobytes() for k in keys}

    def encode_words(self, words: list[str]) -> list[bytes]:
        return [array("I", self.library.encode_ordinary(w)).tobytes() for w in words]


@lru_cache(maxsize=4)
def vocabulary(path: str, library: bool = False) -> Vocabulary:
    """Loaded once in each worker."""
    return Library(path) if library else Vocabulary(path)


STEP = 1 << 16  # tokens decoded at once
SLICE = 3 << 20  # bytes of text handled together, about


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token numbers of each whole text as ``array<int>``, by the file at ``path``.

    A null text counts as empty and gives an empty array; every row gives one row, repeated
    rows included; an existing column of that name is replaced. No shuffle.
    """
    return _through(docs, path, text, ids, None)


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """As ``encode``, and the text that those numbers decode to, in the same pass over the rows."""
    return _through(docs, path, text, ids, decoded)


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with the text of each array of token numbers; a null array gives an empty text."""
    kept = [c for c in rows.columns if c != decoded]
    schema = rows.select(*kept).schema.add(decoded, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            texts = []
            for row in batch.column(kept.index(ids)):
                numbers = np.asarray(row.as_py() or [], dtype="<u4")
                texts.append("".join(voc.decode(numbers[i : i + STEP] for i in range(0, len(numbers), STEP))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, decoded])

    return rows.select(*kept).mapInArrow(run, schema)


def _through(docs: DataFrame, path: str, text: str, ids: str, decoded: str | None) -> DataFrame:
    added = [ids] + ([decoded] if decoded else [])
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept).schema.add(ids, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add(decoded, "string")
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for some in slices(batches, at):
            found = voc.encode_many([x or "" for x in some.column(at).to_pylist()])
            ends = np.cumsum([0, *map(len, found)]).astype("int32")
            more = [pa.ListArray.from_arrays(ends, np.concatenate(found).astype("int32"))]
            if decoded:
                more.append(pa.array(["".join(voc.decode(x[k : k + STEP] for k in range(0, len(x), STEP))) for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays([*some.columns, *more], [*kept, *added])

    return docs.select(*kept).mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], at: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of the string column ``at``, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(lengths), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + size, side="right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def give_back() -> None:
    """Return what a task has freed to the system: workers live on, and what they hold counts beside the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbers of tokens and digests of what ``encode_decode`` returned."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
