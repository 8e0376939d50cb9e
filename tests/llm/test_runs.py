"""Runs against all pairs of neighbouring words at every distance."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoorline.llm import runs
from spoorline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words):
    """Every distance in turn; a multiple of a period that was found finds the same stretch again."""
    number = {w: k for k, w in enumerate(set(words))}
    ids = np.array([number[w] for w in words], dtype=np.int64)
    n, found = len(ids), {}
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[0], (ids[:-q] == ids[q:]).astype(np.int8), [0]])
        turns = np.flatnonzero(np.diff(same))
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if b - a + q >= max(12, 2 * q):
                found.setdefault((a, b - a + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def longhand(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in dropped)


def damaged(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


PIECES = st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=15), st.integers(1, 5)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_runs_equal_brute_force(pieces):
    words = [w for part, times in pieces for w in part * times]
    found = runs.runs(words)
    assert found == brute(words)
    assert runs.collapsed(words, found) == longhand(words, found)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a " * 11, []),
        ("a " * 12, [(0, 12, 1)]),
        ("a b c d e f " * 2, [(0, 12, 6)]),
        ("a b c d e f a b c d e g", []),
        ("x " + "a b c d e f g " * 3 + "a b y", [(1, 23, 7)]),
        ("a a b " * 6, [(0, 18, 3)]),
        ("p " * 13 + "q " * 12, [(0, 13, 1), (13, 12, 1)]),
    ],
)
def test_small_cases(text, expected):
    assert runs.runs(text.encode().split()) == expected


def test_segments_are_those_of_a_plain_walk():
    ids = [0, 1, 0, 0, 1, 0, 1, 1, 0, 0, 1, 0] * 3
    automaton = runs.SuffixAutomaton(ids)
    paths, last = runs.Paths(automaton.link), {}
    for end, state in enumerate(automaton.prefixes):
        expected, x = [], state
        while x >= 0:
            if x in last and (not expected or expected[-1][1] != last[x]):
                expected.append((x, last[x]))
            last[x], x = end, automaton.link[x]
        assert paths.access(state, end) == expected


def test_hard_rows(spark, rows):
    docs = spark.createDataFrame(
        [(1, None, "r"), (2, "", "r"), (3, " \t\n", "r"), (4, "a " * 12, "r"), (4, "a " * 12, "r"), (None, "b b " * 30, "r")],
        "doc_id long, text string, runs string",
    )
    found = rows(docs.select("doc_id", runs.analysed("text").alias("f")).select("doc_id", F.size("f.runs"), "f.collapsed"))
    assert found == sorted([(1, 0, ""), (2, 0, ""), (3, 0, ""), (4, 1, "a"), (4, 1, "a"), (None, 1, "b b")], key=repr)
    assert docs.limit(0).select(runs.analysed("text")).count() == 0


def test_a_long_text():
    words = [b"%d" % (i % 997) for i in range(40_000)]
    assert runs.runs(words) == [(0, 40_000, 997)]
    assert runs.runs([b"%d" % i for i in range(300_000)]) == []


def test_query_equals_brute_force(spark):
    found = {r.doc_id: r for r in QUERIES["op11_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    some = 0
    for doc_id, text in docs:
        words = damaged(doc_id, text)
        listed, row = brute(words), found[doc_id]
        some += bool(listed)
        text = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
        assert row.n_runs == len(listed)
        assert row.runs_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(longhand(words, listed)).hexdigest()
        best = min(listed, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if listed else None)
    assert some > 15
