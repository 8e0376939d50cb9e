"""Language of texts as a mixture, by expectation-maximisation over n-gram likelihoods.

A language is a smoothed distribution over letter trigrams (lower-cased, runs of other
characters read as one space), hashed into a fixed number of buckets, so a model's size
is languages x buckets whatever the corpus. Training counts are Spark sums over every
labelled text.

A text is a mixture of languages. Starting from the single likeliest language, the one
whose addition raises the likelihood fastest joins the set, expectation-maximisation
refits the proportions, and the set is kept if the likelihood gain exceeds the penalty
``PENALTY * log(trigrams)`` per language. The prediction is the language with the
largest proportion, and that proportion its score.

Defined results: a null text or one without a letter is ``und`` with score 0; so is
every text if there is nothing to learn from. Equal proportions go to the first
language in text order. A null doc_id counts as the empty text for the fold. Rows are
independent, so repeated rows need no care; only the named columns are read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.llm.text import column_function, sliced

BUCKETS = 1 << 14
#: Added to each bucket's count before normalising.
SMOOTHING = 0.5
#: Cost of one more language, in units of log(number of trigrams).
PENALTY = 4.0
ROUNDS = 40
#: Largest change of a proportion at which refitting stops.
SETTLED = 1e-4
#: Models wider than this are refused: they would not fit a task's memory.
MAX_LANGUAGES = 2_000
UNKNOWN = "und"

RESULT = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("shares", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each letter trigram of a text; empty if it has no letter."""
    raw = f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, dtype="<u4").astype(np.uint64)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    points[~letter] = 32
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    points, letter = points[keep], letter[keep]
    a, b, c = points[:-2], points[1:-1], points[2:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    found = (mixed >> np.uint64(40)) % np.uint64(BUCKETS)
    return found[letter[1:-1]].astype(np.int64)


def fold(doc_id: Column) -> Column:
    """The remainder that splits learning from held-out documents."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities by bucket, from columns ``text`` and ``lang``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for rows in sliced(batches):
            for row in rows:
                own = totals.setdefault(row["lang"], np.zeros(BUCKETS, dtype=np.int64))
                own += np.bincount(trigrams(row["text"]), minlength=BUCKETS)
            if len(totals) > 32:  # many languages: hand over and start again
                yield from map(as_rows, totals.items())
                totals = {}
        yield from map(as_rows, totals.items())

    def as_rows(item: tuple[str, np.ndarray]) -> pa.RecordBatch:
        lang, own = item
        used = np.flatnonzero(own)
        columns = pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])
        return pa.record_batch([*columns], names=["lang", "bucket", "n"])

    def logs(lang: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = np.full(BUCKETS, SMOOTHING)
        table[rows["bucket"].to_numpy()] += rows["n"].to_numpy()
        return pd.DataFrame({"lang": lang, "logs": [np.log(table / table.sum()).astype(np.float32).tobytes()]})

    known = labelled.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row of 4 * BUCKETS bytes a language; a group has at most BUCKETS rows
    packed = counts.groupBy("lang").applyInPandas(logs, "lang string, logs binary")
    rows = sorted(packed.limit(MAX_LANGUAGES + 1).collect())
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    table = np.frombuffer(b"".join(r.logs for r in rows), np.float32).reshape(len(rows), BUCKETS)
    return [r.lang for r in rows], table


def refit(counts: np.ndarray, likelihood: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions after expectation-maximisation, and the log likelihood they give."""
    total = counts.sum()
    for _ in range(ROUNDS):
        mixed = shares @ likelihood
        new = shares * (likelihood @ (counts / mixed)) / total
        settled = np.abs(new - shares).max() < SETTLED
        shares = new
        if settled:
            break
    return shares, float(counts @ np.log(shares @ likelihood))


def mixture(found: np.ndarray, logs: np.ndarray) -> dict[int, float]:
    """Chosen languages and their proportions for the trigrams of one text."""
    buckets, counts = np.unique(found, return_counts=True)
    counts = counts.astype(np.float64)
    own = logs[:, buckets].astype(np.float64)
    single = own @ counts
    chosen = [int(single.argmax())]
    shares, best = np.ones(1), float(single.max())
    likelihood, total = np.exp(own - own.max(axis=0)), counts.sum()
    offset = float(counts @ own.max(axis=0))
    price = PENALTY * np.log(total + 1)
    while len(chosen) < len(logs):
        slope = likelihood @ (counts / (shares @ likelihood[chosen])) / total
        slope[chosen] = 0
        new = int(slope.argmax())
        if slope[new] <= 1:
            break
        trial = [*chosen, new]
        start = np.append(shares * 0.9, 0.1)
        fitted, reached = refit(counts, likelihood[trial], start)
        if reached + offset - best <= price:
            break
        chosen, shares, best = trial, fitted, reached + offset
    return dict(zip(chosen, shares / shares.sum(), strict=True))


def predictor(languages: list[str], logs: np.ndarray, spark):
    """A column function from text to (lang, score, shares)."""
    shipped = spark.sparkContext.broadcast((languages, logs))

    @column_function(RESULT)
    def predict(slices: Iterator[list]) -> Iterator[list]:
        names, own = shipped.value
        for texts in slices:
            rows = []
            for text in texts:
                found = trigrams(text)
                if not len(found) or not names:
                    rows.append({"lang": UNKNOWN, "score": 0.0, "shares": []})
                    continue
                shares = {names[k]: float(v) for k, v in mixture(found, own).items()}
                lang = min(shares, key=lambda n: (-shares[n], n))
                rows.append({"lang": lang, "score": min(1.0, shares[lang]), "shares": [*shares.items()]})
            yield rows

    return predict


def learned(docs: DataFrame):
    """The predictor trained on the documents outside the held-out fold."""
    seen = docs.where(fold(F.col("doc_id")) != 2)
    return predictor(*train(seen), docs.sparkSession)
