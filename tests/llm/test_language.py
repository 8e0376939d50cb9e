import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorline.llm import language

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score string, shares string"


def likelihood(found, logs, shares):
    return np.log(sum(s * np.exp(logs[k, found].astype(float)) for k, s in shares.items())).sum()


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language.train(docs.where(language.fold(F.col("doc_id")) != 2))


def test_held_out_accuracy(spark):
    from spoorline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op4_language"](spark, SF)
    assert found.count() == docs.count()
    row = found.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.97 and 0 <= row[1] and row[2] <= 1


def test_proportions_maximise_the_likelihood(model, spark):
    languages, logs = model
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {lang: docs.where((F.col("lang") == lang) & (F.length("text") > 2000)).orderBy("doc_id").first().text[:1500] for lang in ("en", "de")}
    found = language.trigrams(texts["en"] + " " + texts["de"][:700])
    shares = language.mixture(found, logs)
    en, de = languages.index("en"), languages.index("de")
    assert set(shares) == {en, de} and 0.55 < shares[en] < 0.8
    best = likelihood(found, logs, shares)
    for share in np.linspace(0.02, 0.98, 49):  # brute force over the simplex of the pair
        assert best >= likelihood(found, logs, {en: share, de: 1 - share}) - 0.05
    assert set(language.mixture(language.trigrams(texts["en"]), logs)) == {en}


def test_the_set_of_languages_is_the_best_of_all_subsets(model, spark):
    languages, logs = model
    few = logs[: min(4, len(languages))]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") > 1500)
    texts = [docs.where(F.col("lang") == lang).orderBy("doc_id").first().text for lang in languages[: len(few)]]

    def penalised(found, chosen):  # long EM from equal shares, over one subset
        buckets, counts = np.unique(found, return_counts=True)
        own = np.exp(few[list(chosen)][:, buckets].astype(np.float64))
        shares = np.full(len(chosen), 1 / len(chosen))
        for _ in range(2000):
            shares = shares * (own @ (counts / (shares @ own))) / counts.sum()
        reached = counts @ np.log(shares @ own)
        return reached - language.PENALTY * np.log(counts.sum() + 1) * (len(chosen) - 1)

    subsets = [c for n in range(1, len(few) + 1) for c in itertools.combinations(range(len(few)), n)]
    mixes = [texts[0][:1200], texts[1][:900] + " " + texts[0][:600], " ".join(t[:500] for t in texts[:3]), " ".join(t[:700] for t in texts)]
    for k, mix in enumerate(mixes, 1):
        found = language.trigrams(mix)
        shares = language.mixture(found, few)
        best = max(penalised(found, c) for c in subsets)
        assert penalised(found, tuple(sorted(shares))) >= best - 0.5
        assert len(shares) == k if k != 2 else set(shares) == {0, 1}


def test_many_languages_are_learned(spark):
    rows = [(k, f"{chr(97 + k % 26)}{chr(97 + k // 26)} word", f"l{k:03d}") for k in range(90)]
    languages, logs = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert languages == [f"l{k:03d}" for k in range(90)] and logs.shape == (90, language.BUCKETS)
    assert np.allclose(np.exp(logs.astype(np.float64)).sum(axis=1), 1, atol=1e-3)
    text = rows[17][1]
    counts = np.full(language.BUCKETS, language.SMOOTHING) + np.bincount(language.trigrams(text), minlength=language.BUCKETS)
    assert (logs[17] == np.log(counts / counts.sum()).astype(np.float32)).all()


def test_nulls_empty_and_clashing_columns(spark):
    rows = [
        (1, "der die das und nicht", "de", "x", None), (2, "the and that with this", "en", None, "y"),
        (3, None, "en", None, None), (4, "", "de", None, None), (5, "1234 !!", None, None, None),
        (None, "the that", None, None, None), (7, "the that", None, None, None), (7, "the that", None, None, None),
        (8, "the that with this " * 20_000, "en", None, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    predict = language.predictor(*language.train(docs.where("doc_id < 8")), spark)
    found = sorted((r[0] or 0, r[1].lang, r[1].score) for r in docs.select("doc_id", predict("text")).collect())
    assert [f[1] for f in found] == ["en", "de", "en", "und", "und", "und", "en", "en", "en"]
    assert found[3][2] == 0.0
    empty = docs.limit(0)
    assert language.train(empty)[0] == []
    nothing = language.learned(empty)
    assert {r[0].lang for r in docs.select(nothing("text")).collect()} == {"und"}


def test_a_tie_goes_to_the_first_language(spark):
    rows = [(1, "abc abd", "b"), (2, "abc abd", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    predict = language.predictor(*language.train(docs), spark)
    assert {r[0].lang for r in docs.select(predict("text")).collect()} == {"a"}
