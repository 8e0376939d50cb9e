import random

import numpy as np
import pytest

from spoorline.llm import contamination
from spoorline.llm.text import shingle_hashes, shingle_texts, words


def grams(own, width):
    return {tuple(own[k : k + width]) for k in range(len(own) - width + 1)}


def brute(docs, items):
    out = []
    for d, text in docs:
        held = {width: grams(words(text), width) for width in range(1, 6)}
        for i, item in sorted(set(items), key=repr):
            width = min(5, len(words(item)))
            own = grams(words(item), width) if width else set()
            if own and 5 * len(own & held[width]) >= 4 * len(own):
                out.append((d, i, len(own & held[width]), len(own)))
    return sorted(out, key=repr)


@pytest.fixture(params=["items travel", "items stay"])
def way(request, monkeypatch):
    if request.param == "items stay":
        monkeypatch.setattr(contamination, "BLOCK_BYTES", 0)


def test_matches_brute_force_around_the_threshold(spark, rows, way):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 8, 20, 45, 90])))) for k in range(60)]
    docs = []
    for d in range(200):
        text = rng.choices(vocabulary, k=rng.choice([0, 2, 30, 2000]))
        for _, item in rng.sample(items, 3):
            own = item.split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                own[rng.randrange(len(own))] = "changed"
            text += own + rng.choices(vocabulary, k=5)
        docs.append((d, " ".join(text)))
    found = contamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    expected = brute(docs, items)
    assert len(expected) > 150 and rows(found) == sorted(expected, key=repr)


def test_short_items_inside_longer_documents(spark, rows, way):
    docs = [(1, "alpha beta gamma delta"), (2, "one two Alpha, beta gamma delta three four"), (3, "alpha beta gamma"), (4, "alpha beta gamma. no delta"), (5, "gamma")]
    items = [("four", "alpha beta gamma delta"), ("one", "gamma"), ("two", "beta gamma")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    found = rows(contamination.contaminated(*frames), "doc_id", "item_id")
    assert found == [(1, "four"), (1, "one"), (1, "two"), (2, "four"), (2, "one"), (2, "two"), (3, "one"), (3, "two"), (4, "one"), (4, "two"), (5, "one")]


def test_nulls_repeats_and_clashing_columns(spark, rows, way):
    docs = [(1, "alpha beta", "x", 1), (2, None, "y", 2), (None, "Alpha, BETA!", "z", 3), (3, "", "q", 4), (1, "alpha beta", "x", 1), (4, "alpha gamma " * 60_000, "l", 5)]
    items = [("a", "alpha beta"), ("a", "alpha beta"), ("b", None), ("c", ""), (None, "gamma alpha gamma alpha gamma")]
    frames = spark.createDataFrame(docs, "doc_id long, text string, item_id string, `key` int"), spark.createDataFrame(items, "item_id string, text string")
    expected = sorted([(1, "a", 1, 1), (1, "a", 1, 1), (None, "a", 1, 1), (4, None, 1, 1)], key=repr)
    assert rows(contamination.contaminated(*frames)) == expected
    kept = contamination.clean(*frames)
    assert kept.columns == frames[0].columns and rows(kept, "doc_id") == [(2,), (3,)]
    assert rows(contamination.contaminated(frames[0].limit(0), frames[1])) == []
    assert rows(contamination.contaminated(frames[0], frames[1].limit(0))) == []
    assert contamination.clean(frames[0], frames[1].limit(0)).count() == len(docs)


def test_a_filter_loses_nothing_and_stops_most(spark):
    own = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    frame = spark.createDataFrame([(int(h),) for h in own], "hash long").repartition(3)
    bloom = contamination.Bloom(contamination.bloom_of(frame, 1 << 16))
    assert len(bloom.among(own)) == len(own)
    assert len(bloom.among(own ^ np.uint64(0x5555555555))) < 60


def test_shingles_as_numbers_and_as_words_agree():
    own = words("one two three four five six seven one two three four five")
    assert len(set(shingle_hashes(own).tolist())) == len(shingle_texts(own))
    assert len(shingle_hashes(words("one two"))) == 1 and len(shingle_hashes([])) == 0
