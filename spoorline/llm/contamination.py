"""Benchmark items inside documents: size-partitioned MinHash containment search.

A document holds an item if it has at least 0.8 of the item's distinct five-word
shingles; an item of one to four words is one shingle of its own width, looked for among
the document's shingles of that width. Items are partitioned by width and size. An item
of n shingles is indexed under its n - ceil(0.8 n) + 1 smallest hashes, its bottom-k
MinHash with k set by the size: a document that lacks all of them has less than 0.8 of
the item, so nothing is missed, which a banded signature could not promise for a short
item in a very long document. A document too short for a partition does not look into
it. Candidates are verified by exact containment of the shingles as words.

Items of up to ``BLOCK_BYTES`` of text travel to the documents, which are read where
they lie. More items than that stay in Spark: the sketches' hashes meet those of the
documents' shingles, of which a Bloom filter of fixed size lets few others through, and
the candidates' texts meet by key for the same verification. Equal texts are searched
once there. Both ways give the same rows.

Defined results: null, empty or wordless texts and items take no part; repeated items
(same id and text) count once; repeated documents each give their rows; a null id stays
null. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.llm.text import SHINGLE_WORDS, THRESHOLD, column_function, named, shingle_hashes, shingle_texts, unused, words
from spoorline.session import stored

#: Bytes of item text that travel to the documents.
BLOCK_BYTES = 16 << 20
#: Size of the filter of sketch hashes (32 MB), and the pages in which it is put together.
BLOOM_BITS, BLOOM_PAGES = 1 << 28, 64


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """The fewest shared shingles that reach the threshold."""
    return math.ceil(round(threshold * size, 9))


def width_of(own: list[str]) -> int:
    """Words of an item's shingles."""
    return min(len(own), SHINGLE_WORDS)


def sketch(hashes: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest hashes, one of which any text that holds the item has."""
    return hashes[: len(hashes) - needed(len(hashes), threshold) + 1]


class Item:
    """The distinct shingles of an item, as sorted hashes and as words."""

    def __init__(self, text: str | None):
        own = words(text)
        self.width = width_of(own)
        self.hashes = np.unique(shingle_hashes(own))
        self.shingles = shingle_texts(own)


class Document:
    """A text's distinct shingles, made for a width when it is first asked for."""

    def __init__(self, text: str | None):
        self.words, self._hashes, self._shingles = words(text), {}, {}

    def hashes(self, width: int) -> np.ndarray:
        if width not in self._hashes:
            own = self.words if len(self.words) >= width else []
            self._hashes[width] = np.unique(shingle_hashes(own, width))
        return self._hashes[width]

    def shared(self, item: Item, threshold: float) -> int:
        """Shingles shared with the item, 0 if below the threshold."""
        found, least = self.hashes(item.width), needed(len(item.hashes), threshold)
        if len(np.intersect1d(item.hashes, found, assume_unique=True)) < least:
            return 0
        if item.width not in self._shingles:
            self._shingles[item.width] = shingle_texts(self.words, item.width)
        shared = len(item.shingles & self._shingles[item.width])
        return shared if shared >= needed(len(item.shingles), threshold) else 0


class Partition:
    """Items of one width and similar size under their smallest hashes."""

    def __init__(self, items: list[int], index: Index):
        own = [index.items[i] for i in items]
        self.width = own[0].width
        self.least = needed(min(len(x.hashes) for x in own), index.threshold)
        sketches = [sketch(x.hashes, index.threshold) for x in own]
        keys, owners = np.concatenate(sketches), np.repeat(items, [len(x) for x in sketches])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]

    def candidates(self, found: np.ndarray) -> set[int]:
        if len(found) < self.least:
            return set()
        low = np.searchsorted(self.keys, found, "left")
        hit = low < len(self.keys)
        hit[hit] = self.keys[low[hit]] == found[hit]
        if not hit.any():
            return set()
        high = np.searchsorted(self.keys, found[hit], "right")
        return {int(o) for a, b in zip(low[hit], high, strict=True) for o in self.owners[a:b]}


class Index:
    """A block of items, partitioned by width and powers of two of their shingle count."""

    def __init__(self, texts: list[str | None], threshold: float):
        self.threshold = threshold
        self.items = [Item(t) for t in texts]
        classes: dict[tuple[int, int], list[int]] = {}
        for i, item in enumerate(self.items):
            if len(item.hashes):
                classes.setdefault((item.width, len(item.hashes).bit_length()), []).append(i)
        self.partitions = [Partition(own, self) for own in classes.values()]

    def held_by(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, shared shingles, shingles of the item) for each item the text holds."""
        document, out = Document(text), []
        for partition in self.partitions:
            for i in sorted(partition.candidates(document.hashes(partition.width))):
                if shared := document.shared(self.items[i], self.threshold):
                    out.append((i, shared, len(self.items[i].shingles)))
        return out


def distinct_items(items: DataFrame) -> DataFrame:
    return items.select("item_id", "text").where("text IS NOT NULL").distinct()


def hit_type(items: DataFrame) -> T.StructType:
    """What is told of an item that a text holds."""
    return T.StructType([items.schema["item_id"], T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType())])


def _holder(rows: list, hit: T.StructType, spark: SparkSession, threshold: float):
    """A column function: the items, given as (item_id, text), that a text holds."""
    shipped = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

    @column_function(T.ArrayType(hit))
    def held(slices: Iterator[list]) -> Iterator[list]:
        ids, texts = shipped.value
        index = Index(texts, threshold)
        for own in slices:
            yield [[{"item_id": ids[i], "n_shared": s, "n_item": n} for i, s, n in index.held_by(t)] for t in own]

    return held


class Bloom:
    """A set of hashes in a fixed number of bits; may take others for members, but loses none."""

    @staticmethod
    def places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
        return [(hashes >> np.uint64(shift)) % np.uint64(size) for shift in (0, 13, 29)]

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, dtype=np.uint8)

    def among(self, hashes: np.ndarray) -> np.ndarray:
        inside = np.ones(len(hashes), dtype=bool)
        for p in self.places(hashes, 8 * len(self.bits)):
            inside &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return hashes[inside]


def bloom_of(sketches: DataFrame, size: int = BLOOM_BITS) -> bytes:
    """The filter of a column of hashes, put together from the parts that tasks set."""

    page = size // 8 // BLOOM_PAGES

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(page * BLOOM_PAGES, dtype=np.uint8)
        for batch in batches:
            for p in Bloom.places(batch["hash"].to_numpy().astype(np.uint64), size):
                np.bitwise_or.at(bits, p >> np.uint64(3), np.left_shift(1, p & np.uint64(7)).astype(np.uint8))
        found = [(k, bits[k * page : (k + 1) * page]) for k in range(BLOOM_PAGES)]
        yield pd.DataFrame([(k, b.tobytes()) for k, b in found if b.any()], columns=["page", "bits"])

    def merged(pages: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pages["bits"]])
        return pd.DataFrame([(pages["page"].iloc[0], bits.tobytes())], columns=["page", "bits"])

    schema = "page int, bits binary"
    pages = sketches.select("hash").mapInPandas(parts, schema).groupBy("page").applyInPandas(merged, schema)
    whole = {r.page: r.bits for r in pages.collect()}  # the filter itself, whose size is fixed
    return b"".join(whole.get(k, bytes(page)) for k in range(BLOOM_PAGES))


def _sketches(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, text in zip(batch["item"], batch["text"], strict=True):
            item = Item(text)
            out += [(h, key, item.width) for h in sketch(item.hashes, threshold).astype(np.int64).tolist()]
        yield pd.DataFrame(out, columns=["hash", "item", "width"])


def held_by_key(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(key, hits) of each distinct text that holds items, by joins of hashes and of candidates."""
    spark, hit = docs.sparkSession, hit_type(items)
    named = F.struct("item_id", "text")
    own = stored(items.select(F.md5(F.to_json(named)).alias("item"), "item_id", "text"), "items")
    sketches = own.mapInPandas(lambda b: _sketches(b, threshold), "hash bigint, item string, width int")
    sketches = stored(sketches, "sketches")
    widths = sorted(r.width for r in sketches.select("width").distinct().collect())  # five at most
    bits = spark.sparkContext.broadcast(bloom_of(sketches))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def promising(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bloom = Bloom(bits.value)
        for texts in batches:
            found = []
            for document in map(Document, texts):
                found.append(np.concatenate([bloom.among(document.hashes(w)) for w in widths] or [[]]).astype(np.int64))
            yield pd.Series(found, dtype=object)

    key = F.md5("text").alias("key")
    hashes = docs.where("text IS NOT NULL").select(key, F.explode(promising("text")).alias("hash")).distinct()
    pairs = stored(hashes.join(sketches, "hash").select("key", "item").distinct(), "candidates")
    wanted = docs.where("text IS NOT NULL").select(key, "text").join(pairs.select("key").distinct(), "key")
    texts = wanted.groupBy("key").agg(F.first("text").alias("doc"))
    met = pairs.join(own, "item").join(texts, "key")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, last, document = [], None, None
            for key, doc, name, text in zip(batch["key"], batch["doc"], batch["item_id"], batch["text"], strict=True):
                if key != last:
                    last, document = key, Document(doc)
                item = Item(text)
                if shared := document.shared(item, threshold):
                    out.append((key, {"item_id": name, "n_shared": shared, "n_item": len(item.shingles)}))
            yield pd.DataFrame(out, columns=["key", "hit"])

    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("hit", hit)])
    return stored(met.select("key", "doc", "item_id", "text").mapInPandas(verify, schema), "held")


def _travels(items: DataFrame) -> bool:
    return (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BLOCK_BYTES


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item that it holds."""
    items = distinct_items(items)
    if _travels(items):
        held = _holder(items.collect(), hit_type(items), docs.sparkSession, threshold)
        hits = docs.select("doc_id", F.explode(held(F.col("text"))).alias("hit"))
    else:
        hits = docs.select("doc_id", F.md5("text").alias("key")).join(held_by_key(docs, items, threshold), "key")
    return hits.select("doc_id", "hit.item_id", "hit.n_shared", "hit.n_item")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    items = distinct_items(items)
    if _travels(items):
        held = _holder(items.collect(), hit_type(items), docs.sparkSession, threshold)
        return docs.where(F.size(held(F.col("text"))) == 0)
    key = unused("key", docs)
    found = held_by_key(docs, items, threshold).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, F.md5("text")).join(found, key, "left_anti").select(*named(docs))
