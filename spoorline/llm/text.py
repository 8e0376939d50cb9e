"""Words and word shingles as 64-bit numbers, shared by the overlap operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words of a shingle, and the similarity from which texts count as near.
SHINGLE_WORDS = 5
THRESHOLD = 0.8

WORD = re.compile(r"[^\W_]+")
#: Word hashes that a worker remembers.
MEMO_SIZE = 150_000
#: Rows of a batch that a column function has as Python values, or as results, at once.
ROWS_AT_ONCE = 256


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_SIZE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


HASHES = WordHashes()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return WORD.findall((text or "").lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(own: list[str], size: int = SHINGLE_WORDS) -> np.ndarray:
    """A number for each run of ``size`` words; a shorter text is one shingle."""
    if not own:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, own), np.uint64, len(own))
    size = min(size, len(h))
    total = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k]
    return mix(total)


def shingle_texts(own: list[str], size: int = SHINGLE_WORDS) -> set[tuple[str, ...]]:
    """The same shingles as words."""
    if not own:
        return set()
    size = min(size, len(own))
    return set(zip(*(own[k : len(own) - size + 1 + k] for k in range(size)), strict=True))


def sliced(batches: Iterator[pa.Array | pa.RecordBatch]) -> Iterator[list]:
    """The rows of batches as Python values, a few at a time; a batch may be a task's whole share."""
    for batch in batches:
        for k in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE).to_pylist()
        del batch
        pa.default_memory_pool().release_unused()


def column_function(kind: T.DataType):
    """Decorator: a column function of one column, from a function of slices of its values.

    Results leave slice by slice too, so neither side ever holds those of a whole batch.
    """

    def decorate(function: Callable[[Iterator[list]], Iterator[list]]):
        @F.arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            arrow = to_arrow_type(kind)
            for results in function(sliced(batches)):
                yield pa.array(results, arrow)

        return run

    return decorate


def unused(name: str, frame: DataFrame) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(frame: DataFrame) -> list[Column]:
    """All columns of a frame, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in frame.columns]
