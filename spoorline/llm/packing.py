"""Documents as token pieces, packed into sequences by the sum of squares.

``pieces`` gives a text's ids, ended by a separator and cut from the end, so that only
the first piece may be short. ``sequences`` packs pieces: largest first, each goes into
the open sequence that leaves the sum, over all residual gaps, of the squared number of
open sequences with that gap smallest; of equal choices into the one with the smallest
gap. A new sequence is opened when none has room.

Sequences are filled block by block: the pieces are dealt into blocks of about ``BLOCK``
by a hash of their row number, so that blocks are alike whatever the keys are, and a task
packs a block. What a block leaves in sequences that are not full, a few hundredths, is
dealt and packed again in the next round, until one block is left, or a round leaves more
than half of its pieces so, which blocks like it would not fill either. A block that is
not dealt again holds one or two sequences more than its tokens need.

Defined results: null and empty texts are the separator alone. Repeated rows and null
ids are rows like others. Empty tables give no pieces. Columns of the input named
``sequence_id`` or ``offset`` are replaced, all others stay, whatever their names. A
length that is null, below one or above the capacity ends the job.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.llm.bpe import byte_alphabet
from spoorline.session import stored

CAPACITY = 2048
#: Pieces of a block, on average.
BLOCK = 20_000

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
)


@functools.lru_cache(maxsize=2)
def encoding(content: str) -> tiktoken.Encoding:
    """The tokenizer of a byte-level file whose ids follow the order of its merges."""
    spec = json.loads(content)
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    ids, model = spec["model"]["vocab"], spec["model"]
    merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or len(ids) != len(byte_of) + len(merged):
        raise ValueError("the file's ids do not stand in the order of its merges")
    return tiktoken.Encoding(
        "file",
        # Fixed value: the splitting pattern of byte-level BPE.
        pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
        mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in ids.items()},
        special_tokens={t["content"]: t["id"] for t in spec.get("added_tokens", [])},
    )


def cut(ids: np.ndarray, capacity: int) -> list[dict]:
    """Pieces of full length but for the first."""
    first = (len(ids) - 1) % capacity + 1
    ends = range(first, len(ids) + 1, capacity)
    starts = [max(0, e - capacity) for e in ends]
    return [
        {"piece": k, "start": s, "length": e - s, "ids": ids[s:e].tobytes()}
        for k, (s, e) in enumerate(zip(starts, ends, strict=True))
    ]


def pieces(spark: SparkSession, path: str, text: str | Column, separator: int = 0, capacity: int = CAPACITY) -> Column:
    """The pieces of a text: number, ids before it, length and ids (packed, little-endian).

    The file's content travels with a broadcast; its size is that of the vocabulary.
    """
    with open(path, encoding="utf-8") as file:
        shipped = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf(PIECES)
    def cut_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = encoding(shipped.value)
        for texts in batches:
            found = []
            for t in texts:
                ids = tokens.encode_to_numpy(t or "", allowed_special="all")
                found.append(cut(np.append(ids, separator).astype("<u4"), capacity))
            yield pd.Series(found, dtype=object)

    return cut_up(text)


def fill(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, whether the sequence stays open) of each of the lengths, given largest first."""
    n = len(lengths)
    count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, gap_of = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    for k, size in enumerate(lengths.tolist()):
        room = count[size:capacity]
        # change of the sum of squares, halved, when gap g becomes g - size
        change = count[: capacity - size] - room + 1.0
        change[0] -= 0.5  # a full sequence is not open
        change[room == 0] = np.inf
        best = int(change.argmin())
        if room[best]:
            gap = size + best
            count[gap] -= 1
            own = by_gap[gap].pop()
        else:
            gap, own = capacity, len(gap_of)
            gap_of.append(capacity)
        sequence[k], offset[k] = own, capacity - gap
        gap_of[own] = gap - size
        if gap > size:
            count[gap - size] += 1
            by_gap[gap - size].append(own)
    return sequence, offset, np.array(gap_of, dtype=np.int64)[sequence] > 0


def sequences(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """The pieces, by their column ``length``, each with a ``sequence_id`` and its ``offset`` there."""
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    fits = F.when(F.col("length").between(1, capacity), F.col("length"))
    size = F.coalesce(fits, F.raise_error(F.lit(f"a piece has 1 to {capacity} tokens")).cast("long"))
    columns = [F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(kept)]
    numbered = pieces.select(*columns, size.cast("long").alias("size"), F.monotonically_increasing_id().alias("number"))
    numbered = stored(numbered, "pieces")

    def packed(table: pa.Table) -> pa.Table:
        lengths, numbers = (table[c].to_numpy() for c in ("size", "number"))
        order = np.lexsort((numbers, -lengths))
        back = np.argsort(order)
        own, offset, still_open = (x[back] for x in fill(lengths[order], capacity))
        where = (table["block"].to_numpy().astype(np.int64) << 32) + own
        for name, values in (("sequence_id", where), ("offset", offset), ("open", still_open)):
            table = table.append_column(name, pa.array(values))
        return table.drop_columns("block")

    names = [f"c{k}" for k in range(len(kept))]
    full = numbered.where(F.col("size") == capacity)
    done = [full.select(*names, (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = numbered.where(F.col("size") < capacity)
    schema = T.StructType(
        [
            *rest.schema.fields,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("open", T.BooleanType()),
        ]
    )
    n, first = rest.count(), 0
    while n:
        blocks = math.ceil(n / block)
        dealt = F.pmod(F.xxhash64(F.col("number"), F.lit(first)), F.lit(blocks)) + first
        placed = stored(rest.withColumn("block", dealt).groupBy("block").applyInArrow(packed, schema), "placed")
        left = placed.where("open").count()
        again = blocks > 1 and 2 * left <= n
        done.append((placed.where("not open") if again else placed).select(*names, "sequence_id", "offset"))
        if not again:
            break
        rest, n, first = placed.where("open").select(rest.columns), left, first + blocks
    return reduce(DataFrame.unionAll, done).toDF(*kept, "sequence_id", "offset")
