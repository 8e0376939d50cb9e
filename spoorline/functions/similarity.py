"""Cosine similarity, as a Spark expression and as an Arrow matrix product."""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.fixed_values import PROMPT_TEMPLATE

# Ship the functions below with the task, so that executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# Scores keep this many decimals: equal vectors must tie wherever they sit in a
# batch, and a matrix product sums its rows in no fixed order.
DECIMALS = 12


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vector columns; null if either is null or has no length."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    length = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.round(_dot(a, b) / F.nullif(length, F.lit(0.0)), DECIMALS)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows without length become NaN."""
    matrix = np.asarray(matrix, dtype=np.float64)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    length[length == 0.0] = np.nan
    return matrix / length


def _vector_rows(vectors: pa.Array, width: int) -> np.ndarray:
    """The present vectors of an Arrow column as unit rows."""
    flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False)
    return unit_rows(flat.reshape(-1, width))


def cosine_to_prompts(prompt_vectors: np.ndarray):
    """Arrow UDF: vector column to the array of cosines with each prompt row.

    One matrix product per Arrow batch. Null vectors give a null array.
    """
    prompts = unit_rows(prompt_vectors)
    count, width = prompts.shape

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(vectors: pa.Array) -> pa.Array:
        products = np.round(_vector_rows(vectors, width) @ prompts.T, DECIMALS).ravel()
        present = vectors.is_valid().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.where(present, count, 0))
        return pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], ends]).astype(np.int32)),
            pa.array(products, mask=np.isnan(products)),
            mask=vectors.is_null(),
        )

    return score


BEST = T.StructType(
    [
        T.StructField("top", T.DoubleType()),
        T.StructField("species", T.StringType()),
        T.StructField("own", T.DoubleType()),
    ]
)


def best_of_prompts(prompt_vectors: list[np.ndarray], names: list[str]):
    """Arrow UDF: vector and label to the best prompt and the label's own cosine.

    Prompts come in blocks; one matrix product per block and Arrow batch, of which only
    the best column is kept. The first of equal prompts wins. Null vectors give null.
    """
    blocks = [unit_rows(v) for v in prompt_vectors]
    ends = np.cumsum([0, *(len(b) for b in blocks)])

    @F.arrow_udf(BEST)
    def best(vectors: pa.Array, labels: pa.Array) -> pa.Array:
        present = vectors.is_valid().to_numpy(zero_copy_only=False)
        rows = _vector_rows(vectors, blocks[0].shape[1])
        species = pa.array(names, pa.string())
        at = pc.index_in(labels.filter(vectors.is_valid()).cast(pa.string()), value_set=species)
        wanted = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        top, first, own = (np.full(len(rows), np.nan) for _ in range(3))
        for begin, end, block in zip(ends, ends[1:], blocks):
            products = np.round(rows @ block.T, DECIMALS)
            filled = np.where(np.isnan(products), -np.inf, products)
            here = filled.argmax(axis=1)
            value = filled[np.arange(len(rows)), here]
            better = (value > -np.inf) & ~(value <= top)
            top[better], first[better] = value[better], here[better] + begin
            inside = np.flatnonzero((wanted >= begin) & (wanted < end))
            own[inside] = products[inside, wanted[inside] - begin]
        none = np.isnan(first)
        chosen = pa.array(np.where(none, 0, first).astype(np.int64), mask=none)
        columns = [
            pa.array(top, mask=np.isnan(top)),
            species.take(chosen),
            pa.array(own, mask=np.isnan(own)),
        ]
        packed = pa.StructArray.from_arrays(columns, names=BEST.fieldNames())
        where = np.cumsum(present) - 1
        return packed.take(pa.array(where, mask=~present))

    return best


# Scores that are handed on at once.
SCORES_AT_ONCE = 1 << 16


def scores_by_block(blocks: list[tuple[list[str], list[int], np.ndarray]], keep: list[str]):
    """``mapInArrow`` function: rows with a vector to rows with each prompt's label, order and score.

    A batch is read once and multiplied by one block of prompts after another, a bounded
    number of scores at a time.
    """
    blocks = [(names, ords, unit_rows(vectors)) for names, ords, vectors in blocks]
    width = blocks[0][2].shape[1]

    def scored(batches):
        for batch in batches:
            rows = _vector_rows(batch.column("embedding"), width)
            kept = batch.select(keep)
            for names, ords, prompts in blocks:
                step = max(1, SCORES_AT_ONCE // len(names))
                for k in range(0, len(rows), step):
                    products = np.round(rows[k : k + step] @ prompts.T, DECIMALS)
                    image = np.repeat(np.arange(k, k + len(products)), len(names))
                    prompt = pa.array(np.tile(np.arange(len(names)), len(products)))
                    flat = products.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            *kept.take(pa.array(image)).columns,
                            pa.array(names, pa.string()).take(prompt),
                            pa.array(ords, pa.int64()).take(prompt),
                            pa.array(flat, mask=np.isnan(flat)),
                        ],
                        names=[*keep, "species", "ord", "score"],
                    )

    return scored


def cosine_to_own_prompt(prompt_vectors: np.ndarray):
    """Arrow UDF: vector and prompt row number to the cosine of the two.

    Rows without a vector or a prompt give null.
    """
    prompts = unit_rows(prompt_vectors)
    width = prompts.shape[1]

    @F.arrow_udf(T.DoubleType())
    def score(vectors: pa.Array, at: pa.Array) -> pa.Array:
        present = vectors.is_valid().to_numpy(zero_copy_only=False)
        row = at.fill_null(-1).to_numpy(zero_copy_only=False)
        own = np.full(len(vectors), np.nan)
        known = row[present] >= 0
        pairs = _vector_rows(vectors, width)[known] * prompts[row[present][known]]
        own[np.flatnonzero(present)[known]] = np.round(pairs.sum(axis=1), DECIMALS)
        return pa.array(own, mask=np.isnan(own))

    return score


def species_prompt(species: str | Column) -> Column:
    """The text prompt of a label column."""
    before, after = PROMPT_TEMPLATE.split("{species}")
    return F.concat(F.lit(before), species, F.lit(after))
