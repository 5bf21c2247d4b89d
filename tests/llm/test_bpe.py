from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import documents, prose
from tokenizers import Tokenizer

from salesmart.llm import bpe
from salesmart.llm.queries import op1_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "12", "é", "<|endoftext|>", "!", "漢字", "😀", "A", "ing", "\x1c", "\x85", " ", "'ll"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)))
def test_encodes_and_decodes_like_the_library(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    for library in (False, True):
        assert bpe.vocabulary(PATH, library).encode(text).tolist() == expected
    halves = [np.array(expected[i : i + 3], "<u4") for i in range(0, len(expected), 3)]
    assert "".join(bpe.vocabulary(PATH).decode(halves)) == LIBRARY.decode(expected, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 3000 + "x", "=-" * 3000, "thestation" * 800, "é漢" * 1500])
def test_long_words_stream_through_a_window(vocabulary, text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert vocabulary.encode(text).tolist() == expected
    word = text.strip().encode()
    stream, found = bpe.Transducer(vocabulary), []
    for i in range(0, len(word), 7):
        found += stream.feed(word[i : i + 7])
        assert len(stream.held) < vocabulary.window  # bounded, however long the word
    assert found + stream.finish() == vocabulary.merge(word)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeinorst", min_size=400, max_size=700), st.text(alphabet="abcdeinorst", max_size=30))
def test_tokens_before_the_lookahead_are_final(start, more):
    vocabulary = bpe.vocabulary(PATH)
    stable = len(start) - vocabulary.lookahead

    def ends(text):
        return [e for e in np.cumsum([len(vocabulary.text_of[t]) for t in vocabulary.merge(text.encode())]).tolist() if e <= stable]

    assert ends(start) == ends(start + more)


def test_lookahead_follows_chains_of_rules():
    assert bpe.sufficient_lookahead([]) == 0
    assert bpe.sufficient_lookahead([(b"b", b"c")]) == 1
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 2  # "ab" may lose its b to a c that follows
    with pytest.raises(ValueError, match="proper"):
        bpe.sufficient_lookahead([(b"ab", b"c")])


def test_bad_bytes_become_replacements(vocabulary):
    lone = [vocabulary.byte_id[0xE6], vocabulary.byte_id[0xBC], vocabulary.byte_id[0x41]]
    assert "".join(vocabulary.decode([np.array([t]) for t in lone])) == b"\xe6\xbcA".decode("utf-8", "replace") == LIBRARY.decode(lone)


def test_edge_rows(spark):
    long = prose(1, 60_000)
    rows = [(1, None), (2, ""), (3, long), (4, "same"), (4, "same"), (None, "no number"), (6, "a <|endoftext|> b")]
    docs = documents(spark, rows)
    clash = docs.withColumnRenamed("source", "ids").withColumnRenamed("lang", "decoded")
    found = bpe.encode_decode(clash, PATH).collect()
    assert len(found) == len(rows)
    for (number, text), row in zip(sorted(rows, key=repr), sorted(found, key=lambda r: repr((r.doc_id, r.text)))):
        assert row.doc_id == number and row.decoded == (text or "")
        assert row.ids == LIBRARY.encode(text or "", add_special_tokens=False).ids
    again = bpe.decode(bpe.encode(docs.limit(2), PATH), PATH).collect()
    assert {r.decoded for r in again} == {""}
    assert bpe.encode(docs.where("false"), PATH).count() == 0


def test_query_digests(spark):
    for row in op1_bpe(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id").collect():
        ids = LIBRARY.encode(row.text or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
