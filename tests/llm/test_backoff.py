import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spoorline.llm import backoff

SF = "/root/testdata/sf0.001"
BEGIN, END = b"<begin of text>", b"<end of text>"  # no words: they hold spaces


def brute(docs, held, order):
    """The model as it is defined, with dictionaries of word tuples."""
    texts = [[*backoff.tokens(t), END] for _, t in docs]
    padded = [[BEGIN, *t] for t in texts]
    counts, kept = Counter(), [t for t, h in zip(padded, held) if not h]
    for t in kept:
        counts[(BEGIN,)] += 1
        for n in range(1, order + 1):
            counts.update(tuple(t[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(t)))
    words = {g for g in counts if len(g) == 1 and g != (BEGIN,)}
    total, distinct = sum(counts[g] for g in words), len(words)

    def klass(w):
        return 0 if w in (BEGIN, END) else min(len(w), backoff.CLASSES - 1)

    weights = {}
    for n in range(2, order + 1):
        once, every = Counter(), Counter()
        for g, c in counts.items():
            if len(g) == n:
                every[klass(g[-2])] += c
                once[klass(g[-2])] += c == 1
        weights[n] = {k: min(max(once[k] / every[k], 1e-6), 1.0) for k in every}

    def prob(g):
        if len(g) == 1:
            return (counts[g] + 1) / (total + distinct + 1)
        low = prob(g[1:])
        if not counts[g[:-1]]:
            return low
        b = weights[len(g)].get(klass(g[-2]), 1.0)
        return (1 - b) * counts[g] / counts[g[:-1]] + b * low

    out = []
    for (d, _), t, p, h in zip(docs, texts, padded, held):
        own = sum(math.log10(prob(tuple(p[max(0, i - order + 1) : i + 1]))) for i in range(1, len(p)))
        base = sum(math.log10((counts[(w,)] + 1) / (total + distinct + 1)) for w in t)
        out.append((d, h, len(t), sum((w,) in counts for w in t), total, base, own))
    return out


def same(found, expected):
    found, expected = sorted(found, key=repr), sorted(expected, key=repr)
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    for f, e in zip(found, expected):
        assert f[5:] == pytest.approx(e[5:], rel=1e-9)


@pytest.mark.parametrize(("order", "chars", "part"), [(1, 10**6, 10**6), (2, 300, 50), (3, 300, 50), (4, 10**6, 10**6)])
def test_matches_the_definition(spark, monkeypatch, order, chars, part):
    monkeypatch.setattr(backoff, "BLOCK_CHARS", chars)
    monkeypatch.setattr(backoff, "PART_KEYS", part)
    rng = random.Random(order)
    words = ["a", "b", "the", "The", "longer", "x" * 30, "é", "</s>", "<s>x"]
    docs = [(k, " ".join(rng.choices(words[: rng.choice([3, 8])], k=rng.choice([0, 1, 2, 9, 40])))) for k in range(80)]
    docs += [(100, docs[5][1]), (101, "never seen words here")]
    held = [d % 7 == 2 or d == 101 for d, _ in docs]
    frame = spark.createDataFrame([(d, t, h) for (d, t), h in zip(docs, held)], "doc_id long, text string, own boolean")
    same(map(tuple, backoff.scored(frame.repartition(3), F.col("own"), order).collect()), brute(docs, held, order))


def test_probabilities_sum_to_at_most_one(spark):
    docs = [(1, "a b a b c"), (2, "b a a"), (3, "c")]
    trial = [(10 + k, f"a {w}") for k, w in enumerate(["a", "b", "c", "zz"])]
    frame = spark.createDataFrame([(*d, False) for d in docs] + [(*d, True) for d in trial], "doc_id long, text string, own boolean")
    found = {r.doc_id: r.score for r in backoff.scored(frame, F.col("own"), 2).collect()}
    lone = brute([*docs, (9, "a")], [False] * 3 + [True], 2)[-1]
    assert sum(10 ** found[10 + k] for k in range(4)) < 1 and lone[6] < 0


def test_nulls_repeats_long_and_clashing_columns(spark):
    docs = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "word " * 100_000)]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, block string, n int")
    held = backoff.fold(F.col("doc_id")) == 2
    outs = [zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d, _ in docs]
    same(map(tuple, backoff.scored(frame, held).collect()), brute(docs, outs, 2))
    assert backoff.scored(frame.limit(0), held).collect() == []
    alone = backoff.scored(frame.where("doc_id = 1"), F.lit(True)).first()
    assert alone.train_tokens == 0 and alone.score == 0.0


def test_query_beats_the_base_on_held_out_texts(spark):
    from spoorline.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    outs = [zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    found = [tuple(r) for r in QUERIES["op2_lm"](spark, SF).collect()]
    same(found, brute(docs, outs, 2))
