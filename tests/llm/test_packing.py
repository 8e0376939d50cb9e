"""Pieces against the library that owns the file; packing by its invariants and bound."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spoorline.llm import packing
from spoorline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokens():
    return packing.encoding(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


HARD = [
    "",
    " ",
    "a<|endoftext|>b <|endoftext|>",
    "<|endoftext",
    "it's we'LL  \n\n x 　y",
    "日本語 😀😀 é",
    "\x00\x1f   ﻿",
    " " * 5000 + "x",
    "ab" * 30_000,
    "!" * 20_000,
]


@pytest.mark.parametrize("text", HARD)
def test_ids_equal_the_library(tokens, library, text):
    assert tokens.encode_to_numpy(text, allowed_special="all").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_ids_equal_the_library_on_any_text(tokens, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert tokens.encode_to_numpy(text, allowed_special="all").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 17, 50])
def test_only_the_first_piece_is_short(n):
    found = packing.cut(np.arange(n, dtype="<u4"), 8)
    assert [p["length"] for p in found[1:]] == [8] * (len(found) - 1)
    assert b"".join(p["ids"] for p in found) == np.arange(n, dtype="<u4").tobytes()
    assert [p["start"] for p in found] == np.cumsum([0, *(p["length"] for p in found)])[:-1].tolist()


def longhand(lengths, capacity):
    """Every open sequence tried, the sum of squares counted anew each time."""
    gaps, out = [], []
    for size in lengths:
        best = None
        for k, gap in enumerate(gaps):
            if gap and gap >= size:
                after = [*gaps[:k], gap - size, *gaps[k + 1 :]]
                counts = defaultdict(int)
                for g in after:
                    counts[g] += 1
                total = sum(c * c for g, c in counts.items() if g)
                if best is None or (total, gap) < best[:2]:
                    best = (total, gap, k)
        if best:
            out.append(capacity - best[1])
            gaps[best[2]] -= size
        else:
            out.append(0)
            gaps.append(capacity - size)
    return out, sorted(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 19), max_size=40))
def test_fill_minimises_the_sum_of_squares(lengths):
    lengths = sorted(lengths, reverse=True)
    sequence, offset, still_open = packing.fill(np.array(lengths, dtype=np.int64), 20)
    expected, gaps = longhand(lengths, 20)
    assert offset.tolist() == expected
    used = defaultdict(int)
    for s, n in zip(sequence.tolist(), lengths, strict=True):
        used[s] += n
    assert sorted(20 - u for u in used.values()) == gaps
    assert [20 - used[s] > 0 for s in sequence.tolist()] == still_open.tolist()


def check(placed, capacity):
    """Sequences without gaps or overlaps; their number."""
    by_sequence = defaultdict(list)
    for r in placed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for held in by_sequence.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_rounds_come_near_the_bound(spark):
    rng = random.Random(3)
    sizes = [(k % 5, min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1), "x") for k in range(6000)]
    frame = spark.createDataFrame(sizes, "doc_id int, length int, `c0` string").repartition(3)
    placed = packing.sequences(frame, block=500).collect()
    assert sorted((r.doc_id, r.length) for r in placed) == sorted((a, b) for a, b, _ in sizes)
    least = -(-sum(s for _, s, _ in sizes) // 2048)
    assert least <= check(placed, 2048) <= least + 12  # one a block


def test_sizes_that_fill_nothing_end_after_one_round(spark):
    placed = packing.sequences(spark.range(900).select(F.lit(1500).alias("length")), block=100).collect()
    assert len(placed) == 900 == check(placed, 2048)


def test_hard_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "word " * 5000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int")
    cut = packing.pieces(spark, PATH, "text")
    frame = docs.select("doc_id", "size", F.lit(7).alias("offset"), F.inline(cut))
    assert [r.length for r in frame.where("doc_id is null").collect()] == [1]
    placed = packing.sequences(frame)
    assert placed.columns == ["doc_id", "size", "piece", "start", "length", "ids", "sequence_id", "offset"]
    assert check(placed.collect(), 2048) == 3
    assert packing.sequences(frame.limit(0)).count() == 0
    with pytest.raises(Exception, match="a piece has 1 to 2048 tokens"):
        packing.sequences(spark.range(1).select(F.lit(0).alias("length"))).collect()


def test_query_equals_the_library(spark, library):
    placed = QUERIES["op12_packing"](spark, SF).collect()
    least = -(-sum(r.length for r in placed) // 2048)
    assert least <= check(placed, 2048) <= least + 2
    by_doc = defaultdict(list)
    for r in placed:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    for doc_id, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        start = 0
        for k, (piece, at, length, crc) in enumerate(sorted(by_doc[doc_id])):
            assert (piece, at) == (k, start) and (length == 2048 or k == 0)
            assert crc == zlib.crc32(ids[at : at + length].tobytes())
            start += length
        assert start == len(ids)
