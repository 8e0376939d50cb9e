"""Exact top-k by integer inner product: the threshold algorithm over sorted lists.

Candidates lie in chunks; a chunk holds, for every dimension, its rows in the order of
that component. A query reads the lists of its non-zero components from their better
ends in step, scores each row it meets by looking up the whole row, and stops when its
k-th best score exceeds the bound: the score of a row that had the last read component
in every list. Rows that score as much as the bound may still win by a smaller id, so
reading goes on until the bound falls below.

Chunks are built where the rows lie. Queries are packed into blocks of bounded size;
every chunk group meets every block, and each meeting gives at most k rows a query,
from which the k best of all are taken. Nothing is held whole anywhere.

Defined results: a vector that is null, or holds null, NaN or an infinite component,
takes no part, neither does a row without id; a shorter vector counts as zero beyond
its end; rows with the query's own id are left out; repeated rows are candidates each,
and a repeated query row is a query of its own; ties go to the smaller id. Scores are
exact, and clipped to the range of a long. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
#: Rows of a chunk, and queries of a block.
CHUNK_ROWS = 1 << 13
BLOCK_QUERIES = 1 << 9
#: Rows and queries that meet in one cell of the grid at most.
CELL_ROWS = 1 << 16
CELL_QUERIES = 1 << 17
#: List entries read a dimension before the bound is looked at the first time.
FIRST_DEPTH = 8
#: Largest product sum that float arithmetic keeps exact.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


class Chunk:
    """Rows as integers, and every dimension's row numbers from small to large."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        self.orders = np.argsort(values, axis=0, kind="stable").T  # a list a dimension
        self.largest = float(np.abs(values).max(initial=0))

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows."""
        if self.largest * np.abs(query).sum() < EXACT:
            return (self.values[rows] @ query).astype(np.int64)
        whole = [[int(x) for x in r] for r in self.values[rows]]
        own = [int(x) for x in query]
        sums = (sum(a * b for a, b in zip(r, own, strict=True)) for r in whole)
        return np.array([max(-LONG - 1, min(LONG, s)) for s in sums], dtype=np.int64)

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, in order; rows of the query's id are left out."""
        n, width = self.values.shape
        own = np.zeros(width)
        own[: min(width, len(query))] = query[:width]
        up, down = np.flatnonzero(own > 0), np.flatnonzero(own < 0)
        seen = self.ids == query_id
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done, depth = 0, FIRST_DEPTH
        while True:
            depth = min(depth, n) if len(up) or len(down) else n
            fresh = np.zeros(n, bool)
            if depth < n:
                fresh[self.orders[up, n - depth : n - done].ravel()] = True
                fresh[self.orders[down, done:depth].ravel()] = True
            else:
                fresh[:] = True  # the lists are read to their ends
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            ids, scores = np.append(ids, self.ids[new]), np.append(scores, self.scores(new, own))
            keep = np.lexsort((ids, ~scores))[:k]  # ~ turns the order round without overflow
            ids, scores = ids[keep], scores[keep]
            if depth >= n or len(scores) == k and scores[-1] > self.bound(up, down, depth, own):
                return ids, scores
            done, depth = depth, depth * 2

    def bound(self, up: np.ndarray, down: np.ndarray, depth: int, query: np.ndarray) -> float:
        """No unread row scores more than this: the last read component of every list."""
        ends = self.values[self.orders[up, len(self.ids) - depth], up] @ query[up]
        ends += self.values[self.orders[down, depth - 1], down] @ query[down]
        return ends if abs(ends) < EXACT else ends + abs(ends) * 1e-9


def _matrix(values: pd.Series) -> np.ndarray:
    width = max((len(v) for v in values), default=0)
    out = np.zeros((len(values), width))
    for k, v in enumerate(values):
        out[k, : len(v)] = v
    return out


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and the integers of each vector that takes part."""
    own = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), own.alias("values"))
        .where(F.col("vec_id").isNotNull() & F.col("values").isNotNull() & fine)
        # floor of the double itself: a long would clip very large components
        .select("vec_id", F.transform("values", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)).alias("values"))
    )


def _packed(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Rows of a task in packs of at most ``size``."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        rows = pd.concat(held, ignore_index=True)
        while len(rows) >= size:
            yield rows[:size]
            rows = rows[size:]
        held = [rows] if len(rows) else []
    if held:
        yield held[0]


def _pack(size: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _packed(batches, size):
            matrix = _matrix(rows["values"])
            if np.abs(matrix).max(initial=0) < 1 << 15:
                matrix = matrix.astype(np.int16)
            yield pd.DataFrame(
                {"ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "width": [matrix.shape[1]], "matrix": [matrix.tobytes()]}
            )

    return pack


def _unpacked(ids: bytes, width: int, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    small = len(matrix) == 2 * len(ids) * width
    return ids, np.frombuffer(matrix, np.int16 if small else np.float64).reshape(len(ids), width).astype(np.float64)


def _meet(k: int):
    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, chunk = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.chunk != last:  # the lists of a chunk serve all blocks that follow
                    last, chunk = row.chunk, Chunk(*_unpacked(row.c_ids, row.c_width, row.c_matrix))
                queries, matrix = _unpacked(row.ids, row.width, row.matrix)
                found = [chunk.best(int(q), v, k) for q, v in zip(queries, matrix, strict=True)]
                counts = [len(f[0]) for f in found]
                yield pd.DataFrame(
                    {
                        "block": row.block,
                        "place": np.repeat(np.arange(len(queries)), counts),
                        "query_id": np.repeat(queries, counts),
                        "vec_id": np.concatenate([f[0] for f in found]),
                        "score": np.concatenate([f[1] for f in found]),
                    }
                )

    return meet


def search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of every query.

    Chunks and query blocks meet on a grid: each is copied along one side only, and a
    cell holds at most about ``CELL_ROWS`` rows and ``CELL_QUERIES`` queries.
    """
    spark = vectors.sparkSession
    pack, number = "ids binary, width int, matrix binary", F.monotonically_increasing_id()
    wanted, n, tasks = quantised(queries), vectors.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    m = wanted.count()
    row_groups = max(-(-n // CELL_ROWS), min(tasks, -(-n // 512)), 1)
    query_groups = max(-(-m // CELL_QUERIES), 1)

    def numbered(frame: DataFrame, name: str, own: str, groups: int, other: str, copies: int) -> DataFrame:
        out = frame.withColumn(name, number).withColumn(own, F.pmod(F.xxhash64(name), F.lit(groups)))
        return out.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    # dealt evenly whatever the rows hold, so that packs are full and no group is large
    rows = quantised(vectors).withColumn("deal", F.pmod(number, F.lit(row_groups)))
    # sorted, so that a task that runs again after a loss makes the same packs
    rows = rows.repartition(row_groups, "deal").select("vec_id", "values")
    rows = rows.sortWithinPartitions("vec_id", "values")
    chunks = rows.mapInPandas(_pack(CHUNK_ROWS), pack)
    chunks = chunks.select(*(F.col(c).alias(f"c_{c}") for c in chunks.columns))
    chunks = numbered(chunks, "chunk", "i", row_groups, "j", query_groups)
    own = wanted.withColumn("deal", F.pmod(number, F.lit(max(1, -(-m // BLOCK_QUERIES)))))
    own = own.repartition(max(1, min(tasks, -(-m // BLOCK_QUERIES))), "deal").select("vec_id", "values")
    own = own.sortWithinPartitions("vec_id", "values")
    blocks = numbered(own.mapInPandas(_pack(BLOCK_QUERIES), pack), "block", "j", query_groups, "i", row_groups)
    pairs = chunks.join(blocks, ["i", "j"]).select("chunk", "c_ids", "c_width", "c_matrix", "block", "ids", "width", "matrix")
    found = pairs.mapInPandas(_meet(k), "block long, place int, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
