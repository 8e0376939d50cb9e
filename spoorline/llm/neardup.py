"""Near-duplicate texts by ProbMinHash, banding and verification.

A text is its five-word shingles with their frequencies. ProbMinHash gives each shingle
a Poisson process of arrivals with its share as the rate; every register keeps the
shingle that arrives first, and a shingle stops arriving once it is later than all
registers. Two registers agree with the probability Jaccard similarity of the texts,
which for texts without repeated shingles is their Jaccard similarity.

Equal texts are one. ``BANDS`` bands of ``BAND_ROWS`` registers put texts of
similarity 0.8 into a common bucket but for 5 in a million. A bucket is searched first
from its most central text, the one whose buckets are fullest: those pairs are verified
exactly, and linked texts grow into classes, so a bucket of copies costs its size. Only
buckets that then hold several classes are looked at again, in blocks, and only for
pairs across classes that share no earlier bucket; a task that has linked two classes
does not compare them further, and hands on links, not pairs.

Defined results: the smallest doc_id names a class; a null or empty text, or one
without a word, is alike to equal ones only (null and empty are equal); a text shorter
than five words is one shingle; repeated rows are copies; null ids are kept. Only the
named columns are read, and ``deduplicated`` keeps them all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.llm.components import components
from spoorline.llm.text import THRESHOLD, column_function, mix, named, shingle_hashes, unused, words
from spoorline.session import stored

BANDS = 40
BAND_ROWS = 6
#: Texts of a bucket of several classes that are compared with as many others in a task.
BLOCK = 512
#: Rows that such a task gets together, of small buckets many.
TASK_ROWS = 4096

STEP = np.uint64(0x9E3779B97F4A7C15)
#: Arrivals that are drawn at once.
DRAWS = 1 << 15
#: Texts whose shingles a verifying task remembers.
VERIFIED_AT_ONCE = 32
#: Shingles that a linking task remembers, of one text at least.
SHINGLES_AT_ONCE = 1 << 20


def weighted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a text and their shares."""
    found, counts = np.unique(shingle_hashes(words(text)), return_counts=True)
    return found, counts / max(1, counts.sum())


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """The first arrival's element in every register of every text, a row a text.

    Texts of like size are drawn together, which does not change what each draws.
    """
    out = np.zeros((len(texts), registers), dtype=np.uint64)
    wanted = 1.2 * registers * (np.log(registers) + 1)  # arrivals that fill nearly all registers
    order = sorted((k for k in range(len(texts)) if len(texts[k][0])), key=lambda k: len(texts[k][0]))
    while order:
        size = len(texts[order[0]][0])
        count = max(1, round(wanted / size))
        take = max(1, DRAWS // (size * count))
        group, order = order[:take], order[take:]
        out[group] = _first_arrivals([texts[k] for k in group], registers, count)
    return out


def _first_arrivals(texts: list[tuple[np.ndarray, np.ndarray]], registers: int, count: int) -> np.ndarray:
    elements, weights = (np.concatenate(part) for part in zip(*texts, strict=True))
    text = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
    first = np.full(len(texts) * registers, np.inf)
    winner = np.zeros(len(first), dtype=np.uint64)
    times, begin = np.zeros(len(elements)), 0
    while len(elements):
        steps = np.arange(begin + 1, begin + count + 1, dtype=np.uint64) * STEP
        draws = mix(elements[:, None] + steps)
        # the upper bits are the waiting time, the lower ones the register
        waits = -np.log(((draws >> np.uint64(24)) + 0.5) * 2.0**-40) / weights[:, None]
        arrivals = times[:, None] + np.cumsum(waits, axis=1)
        places = ((draws & np.uint64(0xFFFFFF)) * np.uint64(registers)) >> np.uint64(24)
        places = places.astype(np.int64) + (text * registers)[:, None]
        row, column = np.nonzero(arrivals < first[places])
        at, place = arrivals[row, column], places[row, column]
        order = np.argsort(-at)  # of several, the soonest is written last
        place = place[order]
        first[place], winner[place] = at[order], elements[row[order]]
        last = arrivals[:, -1]
        alive = last < first.reshape(-1, registers).max(axis=1)[text]
        elements, weights, times, text = elements[alive], weights[alive], last[alive], text[alive]
        begin, count = begin + count, 1
    return winner.reshape(-1, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common d of 1 / sum over i of max(v_i / v_d, w_i / w_d)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    keys = np.union1d(a[0], b[0])
    v, w = np.zeros(len(keys)), np.zeros(len(keys))
    v[np.searchsorted(keys, a[0])], w[np.searchsorted(keys, b[0])] = a[1], b[1]
    with np.errstate(divide="ignore"):
        ratio = v / w
    order = np.argsort(-ratio, kind="stable")
    v, w = v[order], w[order]
    upper = np.cumsum(v)  # of ratios at least as large; equal ratios give equal terms either way
    lower = w.sum() - np.cumsum(w)
    common = (v > 0) & (w > 0)
    return float((1 / (upper[common] / v[common] + lower[common] / w[common])).sum())


def _buckets(texts: list[str | None]) -> list[list[int]]:
    own = [weighted(t) for t in texts]
    drawn = signatures(own, BANDS * BAND_ROWS).reshape(-1, BANDS, BAND_ROWS)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), drawn.shape[:2])
    for k in range(BAND_ROWS):
        total = mix(total * STEP + drawn[:, :, k])
    rows = total.view(np.int64).tolist()
    return [row if len(t[0]) else [] for row, t in zip(rows, own, strict=True)]


@column_function(T.ArrayType(T.LongType()))
def bands(slices: Iterator[list]) -> Iterator[list]:
    """Column function: the bucket of a text in every band; none without a word."""
    yield from map(_buckets, slices)


def text_key() -> Column:
    """What equal texts have in common."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key")


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("")).alias("did")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(key, bands, doc_id, n): each text once, with its smallest id and its copies."""
    own = docs.select("doc_id", text_key(), bands("text").alias("bands"))
    return stored(own.groupBy("key").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "texts")


def contents(docs: DataFrame, texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of the distinct texts with the given keys."""
    wanted = keys.select("key").distinct().join(texts.select("key", id_text(F.col("doc_id"))), "key")
    found = docs.select(text_key(), id_text(F.col("doc_id")), "text").join(wanted, ["key", "did"])
    return stored(found.dropDuplicates(["key", "did"]).select("key", "text"), "contents")


def verified(text: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are that similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def of(key: bytes, text: pa.Scalar):
            if key not in memo:
                if len(memo) >= VERIFIED_AT_ONCE:
                    memo.clear()
                memo[key] = weighted(text.as_py())
            return memo[key]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts_a, texts_b = batch.column("text_a"), batch.column("text_b")
            keep = [similar(of(a[k], texts_a[k]), of(b[k], texts_b[k]), threshold) for k in range(len(a))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(text.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(text.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return stored(both.mapInArrow(verify, "a binary, b binary"), "links")


def similar(a, b, threshold: float) -> bool:
    """Whether two weighted texts are that similar; most that are not show it at once."""
    if not len(a[0]) or not len(b[0]):
        return False
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    hit = a[0][at] == b[0]
    # no term exceeds the shingle's own share in either text
    if b[1][hit].sum() < threshold - 1e-9 or a[1][at[hit]].sum() < threshold - 1e-9:
        return False
    return probability_jaccard(a, b) >= threshold - 1e-9


def _linker(threshold: float):
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between classes in pairs of blocks, several of which come together."""
        codes = pd.factorize(rows["label"])[0]
        parent = list(range(codes.max() + 1))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        bands = np.array(rows["bands"].tolist())
        keys, texts = rows["key"].tolist(), rows["text"].tolist()
        band, block, left, right = (rows[c].to_numpy() for c in ("band", "block", "left", "right"))
        order = np.lexsort((right, left, band))
        same = (np.diff(band[order]) == 0) & (np.diff(left[order]) == 0) & (np.diff(right[order]) == 0)
        memo, held = {}, 0

        def of(i: int):
            nonlocal held
            if keys[i] not in memo:
                own = weighted(texts[i])
                held += len(own[0])
                if held > SHINGLES_AT_ONCE:
                    memo.clear()
                    held = len(own[0])
                memo[keys[i]] = own
            return memo[keys[i]]

        out = []
        for part in np.split(order, np.flatnonzero(~same) + 1):
            within, bucket = left[part[0]] == right[part[0]], band[part[0]]
            a_side, b_side = part[block[part] == left[part[0]]], part[block[part] == right[part[0]]]
            for k, x in enumerate(a_side):
                others = b_side[k + 1 :] if within else b_side
                others = others[codes[others] != codes[x]]
                if not len(others):
                    continue
                shared = bands[others] == bands[x]
                here = bands[others, shared.argmax(axis=1)] == bucket  # else an earlier bucket has the pair
                others, count = others[here], shared[here].sum(axis=1)
                for y in others[np.argsort(-count, kind="stable")].tolist():
                    a, b = root(codes[x]), root(codes[y])
                    if a != b and similar(of(x), of(y), threshold):
                        parent[max(a, b)] = min(a, b)
                        out.append((keys[x], keys[y]))
        return pd.DataFrame(out, columns=["a", "b"])

    return link


def links_across(members: DataFrame, labels: DataFrame, texts: DataFrame, text: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between classes that share a bucket, beside those of its first text."""
    own = members.where("first <> key").join(labels, "key", "left")
    own = stored(own.select("band", "key", F.coalesce("label", "key").alias("label")), "members")
    mixed = own.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
    mixed = stored(mixed.where("low <> high").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n"), "mixed")
    rows = mixed.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    rest = own.join(mixed.drop("n"), "band").withColumn("block", F.pmod(F.xxhash64("key", "band"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = rest.withColumn("other", other).withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    whole = texts.select("key", "bands").join(text, "key")
    met = met.join(whole, "key").select("band", "left", "right", "block", "key", "label", "bands", "text")
    task = F.pmod(F.xxhash64("band", "left", "right"), F.lit(max(1, rows // TASK_ROWS)))
    return stored(met.groupBy(task).applyInPandas(_linker(threshold), "a binary, b binary"), "links")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(texts, labels)``: the distinct texts, and the class of those that have others."""
    texts = distinct_texts(docs)
    buckets = texts.select(F.explode("bands").alias("band"), "key")
    full = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(buckets.join(full, "band"), "members")
    central = shared.groupBy("key").agg(F.sum("n").alias("central"))
    leaders = shared.join(central, "key").groupBy("band").agg(F.max(F.struct("central", "key"))["key"].alias("first"))
    members = stored(shared.select("band", "key").join(leaders, "band"), "members")
    stars = members.where("first <> key").select(F.col("first").alias("a"), F.col("key").alias("b"))
    stars = stored(stars.distinct(), "pairs")
    text = contents(docs, texts, members)
    links = verified(text, stars, threshold)
    labels = components(links)
    links = links.union(links_across(members, labels, texts, text, threshold))
    return texts, components(links)


def class_table(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_id, class_docs, class_texts, keep): by distinct text.

    ``keep`` holds the key and id text of the one document that stays of the class.
    """
    texts, labels = classes(docs, threshold)
    own = texts.join(labels, "key", "left").select("key", "doc_id", "n", F.coalesce("label", "key").alias("label"))
    own = stored(own, "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    table = own.groupBy("label").agg(first.alias("first"), F.sum("n").alias("class_docs"), F.count("*").alias("class_texts"))
    return own.join(table, "label").select(
        "key",
        F.col("first.doc_id").alias("class_id"),
        "class_docs",
        "class_texts",
        F.struct(F.col("first.key").alias("key"), id_text(F.col("first.doc_id"))).alias("keep"),
    )


def classified(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_docs and class_texts of every document."""
    own = docs.select("doc_id", text_key())
    return own.join(class_table(docs, threshold).drop("keep"), "key").drop("key")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the smallest id, with all its columns."""
    keep = class_table(docs, threshold).select("keep.key", "keep.did").distinct()
    key, did = unused("class_key", docs), unused("class_did", docs)
    own = docs.withColumns({key: text_key(), did: id_text(F.col("doc_id"))})
    kept = own.join(keep.select(F.col("key").alias(key), F.col("did").alias(did)), [key, did], "left_semi")
    return kept.dropDuplicates([key, did]).select(*named(docs))
