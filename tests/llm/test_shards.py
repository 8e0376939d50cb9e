import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spoorline.llm import shards


def fits(sizes, capacity, n):
    used, space = 1, capacity
    for s in sizes:
        if s > capacity:
            return False
        if s > space:
            used, space = used + 1, capacity
        space -= s
    return used <= n


def smallest(sizes, n):
    return next(c for c in range(max(sizes), sum(sizes) + 1) if fits(sizes, c, n))


def ends_of(sizes, cells):
    ends, place = [], 0
    for s in sizes:
        place += s
        ends.append(place)

    def divide(wanted):
        out = []
        for first, last in wanted:
            width, parts = max(1, -(-(last - first + 1) // cells)), defaultdict(list)
            for e in ends:
                if first <= e <= last:
                    parts[(e - first) // width].append(e)
            out += [(min(p), max(p)) for p in parts.values()]
        return sorted(out)

    return shards.Ends(place, max(sizes), divide), ends


@pytest.mark.parametrize("seed", range(60))
def test_capacity_is_the_smallest(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 8, 9, rng.randint(8, 400)]) for _ in range(rng.randint(1, 300))]
    if seed % 3 == 0:
        sizes[rng.randrange(len(sizes))] = sum(sizes) // 2 + 1
    n = rng.choice([1, 2, 5, 24])
    own, ends = ends_of(sizes, rng.choice([2, 7, 64]))
    best = smallest(sizes, n)
    assert own.capacity(n) == best
    cuts = own.cuts(n)
    assert cuts[-1] == sum(sizes) and cuts == sorted(cuts) and set(cuts) <= {0, *ends}
    assert max(b - a for a, b in zip([0, *cuts], cuts)) <= best


def check(docs, found, n):
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in found) == sorted(
        (d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs
    )
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) and 0 <= k < n for k, s in slots.items())


def test_whole_query(spark):
    from spoorline.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op8_shards"](spark, sf_dir).collect()
    check(docs, found, 24)
    shard = {r.doc_id: r.shard for r in found}
    of_text, groups = defaultdict(set), defaultdict(int)
    for d, t in docs:
        of_text[t].add(shard[d])
        groups[t] += len(t.encode()) + 8
    assert all(len(s) == 1 for s in of_text.values())
    import hashlib

    in_order = [groups[t] for t in sorted(groups, key=lambda t: hashlib.sha256(t.encode()).digest())]
    total = defaultdict(int)
    for r in found:
        total[r.shard] += r.size
    assert max(total.values()) <= smallest(in_order, 24) and len(total) == 24
    assert min(total.values()) > 0.6 * max(total.values())


def test_nulls_repeats_hot_group_and_clashing_columns(spark):
    docs = [(None, None), (1, None), (1, None), (2, ""), (3, "é" * 50_000)] + [(k, "copy") for k in range(10, 400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit("x")).withColumn("grp", F.lit(1))
    found = shards.by_bytes(frame, 24).collect()
    check(docs, found, 24)
    assert len({r.shard for r in found if r.size == 12}) == 1 and len({r.shard for r in found if r.size == 8}) == 1
    assert shards.by_bytes(frame.limit(0), 24).collect() == []
