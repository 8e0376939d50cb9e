import math
import random

import numpy as np
import pytest

from spoorline.llm import topk

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k):
    fine = [
        (i, [math.floor(1024 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in fine:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def search(spark, rows, k):
    frame = spark.createDataFrame(rows, SCHEMA)
    return topk.search(frame.where("vec_id % 100 = 0"), frame, k)


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force_with_ties(spark, rows, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(topk, "CELL_ROWS", 150)
    monkeypatch.setattr(topk, "CELL_QUERIES", 2)
    data = [(k, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(6)]) for k in range(700)]
    assert rows(search(spark, data, 10)) == sorted(brute(data, 10), key=repr)


def test_bad_vectors_short_vectors_repeats_and_few_rows(spark, rows):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (6, [1.0]), (None, [9.0, 9.0]), (7, [-1.0, 0.0, 5.0]), (100, [0.0, 0.0]), (200, [1e9, -1e9]), (300, [1e300])]
    expected = [r for r in brute(data, 10) if r[0] not in (200, 300)]
    found = rows(search(spark, data, 10))
    assert [r for r in found if r[0] in (0, 100) and r[2] < 300] == sorted([r for r in expected if r[2] < 300], key=repr)
    assert all(abs(r[3]) <= topk.LONG + 1 for r in found)
    repeated = [(0, [1.0]), (5, [1.0]), (5, [1.0]), (6, [0.5])]
    assert rows(search(spark, repeated, 10)) == [(0, 1, 5, 1 << 20), (0, 2, 5, 1 << 20), (0, 3, 6, 1 << 19)]
    assert rows(search(spark, repeated[:1], 10)) == []
    assert rows(search(spark, data[:0], 10)) == []


def test_clashing_columns(spark, rows):
    frame = spark.createDataFrame([(0, [1.0], "x", 1), (3, [2.0], "y", 2)], SCHEMA + ", score string, query_id int")
    assert rows(topk.search(frame.where("vec_id = 0"), frame, 5)) == [(0, 1, 3, 1 << 21)]


def test_reading_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(1)
    values = np.floor(rng.normal(size=(4000, 4)) * 100)
    values[7] = 2000
    chunk, calls = topk.Chunk(np.arange(4000), values), []
    score = chunk.scores
    chunk.scores = lambda rows, q: calls.append(len(rows)) or score(rows, q)
    ids, _ = chunk.best(-1, np.ones(4), 1)
    assert ids.tolist() == [7] and sum(calls) < 200
