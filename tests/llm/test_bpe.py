import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spoorline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
LIBRARY = Tokenizer.from_file(PATH)
PIECES = [" ", "\n", "\t", "\x1c", "\x85", "a", "é", "1", "'", "'re", "'ll", "!", "<|endoftext|>", "<|endof", "😀", "the", "ing", "  "]
LONG = [
    "",
    "a" * 100_000,
    "hello" * 20_000 + " 1" * 10,
    " " * 90_000 + "x",
    "1234567890" * 9_000,
    "the" * 30_000 + "<|endoftext|>" + "é" * 70_000,
    "=" * 100_000 + "'re",
]


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@given(st.one_of(st.lists(st.sampled_from(PIECES)).map("".join), st.text()))
@settings(max_examples=300, deadline=None)
def test_encodes_and_decodes_as_the_library(text):
    packed = bpe.encode_text(VOCABULARY, text)
    assert ids(packed) == expected(text)
    assert bpe.decode_ids(VOCABULARY, packed) == text


@pytest.mark.parametrize("text", LONG, ids=range(len(LONG)))
@pytest.mark.parametrize("size", [777, 70_000])
def test_slices_do_not_matter(text, size):
    encoder = bpe.Encoder(VOCABULARY)
    packed = b"".join(encoder.feed(text[k : k + size]) for k in range(0, len(text), size))
    packed += encoder.finish()
    assert ids(packed) == expected(text)
    if encoder.window:
        assert len(encoder.window.held) <= encoder.window.limit


def test_window_stays_small_and_emits_early():
    encoder, emitted = bpe.Encoder(VOCABULARY), 0
    for _ in range(100):
        emitted += len(encoder.feed("abcde" * 2_000)) // 4
        if encoder.window:
            assert len(encoder.window.held) <= encoder.window.limit
        assert len(encoder.rest) <= bpe.SLICE + 10_000
    assert emitted > 100_000


def test_lookahead_covers_a_chain_of_merges():
    merges = [(b"c", b"d"), (b"b", b"cd"), (b"a", b"bcd")]
    assert bpe.lookahead(merges) >= 3


def test_decoder_replaces_broken_bytes_as_the_library():
    broken = expected("é")[:1] if len(expected("é")) > 1 else [VOCABULARY.byte_ids[0xC3]]
    packed = np.array([*broken, *expected("x")], "<u4").tobytes()
    assert bpe.decode_ids(VOCABULARY, packed) == LIBRARY.decode([*broken, *expected("x")], skip_special_tokens=False)


def test_columns_nulls_and_empty_tables(spark):
    encode, decode, round_trip = bpe.codec(spark, PATH)
    rows = [(1, None, "x"), (None, "Hello world", "y"), (1, "", "z"), (1, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = docs.withColumn("packed", encode("text")).withColumn("decoded", decode("packed"))
    found = sorted((r.ids, ids(r.packed), r.decoded) for r in out.collect())
    assert found == [("x", [], ""), ("y", expected("Hello world"), "Hello world"), ("z", [], ""), ("z", [], "")]
    assert {(ids(r.t.ids) == expected(r.text or ""), r.t.text) for r in docs.select("text", round_trip("text").alias("t")).collect()} == {(True, ""), (True, "Hello world")}
    assert docs.limit(0).select(encode("text").alias("e")).count() == 0


def test_query_matches_the_library(spark):
    from spoorline.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for row in QUERIES["op10_bpe"](spark, sf_dir).collect():
        own = expected(texts[row.doc_id])
        assert row.n_tokens == len(own)
        assert row.ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        decoded = LIBRARY.decode(own, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
