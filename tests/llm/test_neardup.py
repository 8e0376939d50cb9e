import random

import numpy as np
import pytest

from spoorline.llm import neardup


def brute_similarity(a, b):
    """Probability Jaccard as it is defined."""
    (x, v), (y, w) = neardup.weighted(a), neardup.weighted(b)
    v, w = dict(zip(x.tolist(), v)), dict(zip(y.tolist(), w))
    keys = set(v) | set(w)
    total = 0.0
    for d in set(v) & set(w):
        total += 1 / sum(max(v.get(i, 0) / v[d], w.get(i, 0) / w[d]) for i in keys)
    return total


def brute_classes(docs, threshold=0.8):
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, s) in enumerate(docs):
        for j, (_, t) in enumerate(docs[:i]):
            if (s or "") == (t or "") or brute_similarity(s, t) >= threshold - 1e-9:
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(root(i), []).append(d)
    return sorted(((d, min(x for x in g if x is not None), len(g)) for g in groups.values() for d in g), key=repr)


def altered(rng, text, times):
    own = text.split()
    for _ in range(times):
        own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
    return " ".join(own)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(500)}"
    passage = " ".join(word() for _ in range(60))
    docs = []
    for _ in range(25):
        base = " ".join(word() for _ in range(rng.choice([3, 40, 120, 200])))
        if rng.random() < 0.3:
            base = " ".join([base] * 3)  # repeated shingles have weight
        if rng.random() < 0.3:
            base += " " + passage
        docs += [base] * rng.choice([1, 1, 3])
        docs += [altered(rng, base, rng.choice([1, 2, 3, 5])) for _ in range(rng.choice([0, 1, 4]))]
    base = " ".join(word() for _ in range(150))
    for _ in range(12):  # a chain: ends are far apart, neighbours near
        docs.append(base)
        base = altered(rng, base, 1)
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_signature_estimates_the_similarity():
    rng = random.Random(3)
    for _ in range(5):
        a = " ".join(f"w{rng.randrange(200)}" for _ in range(150)) + " same words again and again" * rng.choice([0, 9])
        b = altered(rng, a, 3)
        true = brute_similarity(a, b)
        assert neardup.probability_jaccard(neardup.weighted(a), neardup.weighted(b)) == pytest.approx(true)
        own = [neardup.weighted(t) for t in (a, b, "", "other words", a * 3)]
        drawn = neardup.signatures(own, 4000)
        assert (neardup.signatures(own[1:2], 4000)[0] == drawn[1]).all()  # by itself as with others
        equal = np.mean(drawn[0] == drawn[1])
        assert equal == pytest.approx(true, abs=0.04)


def test_unit_weights_give_jaccard():
    a, b = "a b c d e f g h i", "a b c d e f g h z"
    assert neardup.probability_jaccard(neardup.weighted(a), neardup.weighted(b)) == pytest.approx(4 / 6)


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 3)])
def test_classes_match_brute_force(spark, rows, monkeypatch, seed, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = corpus(seed)
    found = neardup.classified(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows(found, "doc_id", "class_id", "class_docs") == sorted(brute_classes(docs), key=repr)


def test_nulls_repeats_ties_and_clashing_columns(spark, rows):
    docs = [(5, None), (6, ""), (7, "!!"), (None, "a b c"), (2, "A, b c"), (2, "A, b c"), (9, "word " * 30_000), (10, "word " * 30_001)]
    frame = spark.createDataFrame([(d, t, d or 0, "k") for d, t in docs], "doc_id long, text string, class_id long, key string")
    found = rows(neardup.classified(frame), "doc_id", "class_id", "class_docs")
    assert found == sorted([(5, 5, 2), (6, 5, 2), (7, 7, 1), (None, 2, 3), (2, 2, 3), (2, 2, 3), (9, 9, 2), (10, 9, 2)], key=repr)
    kept = neardup.deduplicated(frame)
    assert kept.columns == frame.columns and rows(kept, "doc_id") == [(2,), (5,), (7,), (9,)]
    assert neardup.classified(frame.limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, "x y"), (None, "x y")], "doc_id long, text string")
    assert rows(neardup.deduplicated(nameless)) == [(None, "x y")]
