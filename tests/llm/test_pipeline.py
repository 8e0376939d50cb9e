import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spoorline.llm import language, neardup, pii
from spoorline.llm.text import shingle_texts, words

SF = "/root/testdata/sf0.001"


def brute(docs, items):
    """Every stage by itself in plain Python."""
    counts = {}
    for d in docs:
        if zlib.crc32(str("" if d["doc_id"] is None else d["doc_id"]).encode()) % 4 != 2 and d["lang"] is not None and d["text"] is not None:
            counts.setdefault(d["lang"], np.full(language.BUCKETS, language.SMOOTHING))
            counts[d["lang"]] += np.bincount(language.trigrams(d["text"]), minlength=language.BUCKETS)
    names = sorted(counts)
    logs = np.log(np.array([counts[n] / counts[n].sum() for n in names])).astype(np.float32)
    kept = []
    for d in docs:
        found = language.trigrams(d["text"])
        if len(found) and max(language.mixture(found, logs).values()) >= corpus_pipeline.LEAST_SHARE:
            kept.append(d)
    near = [neardup.weighted(d["text"]) for d in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if kept[i]["text"] == kept[j]["text"] or neardup.probability_jaccard(near[i], near[j]) >= 0.8:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    first = {}
    for d, g in sorted(zip(kept, group), key=lambda x: x[0]["doc_id"]):
        first.setdefault(g, d)
    held = [s for s in (shingle_texts(words(t)) for t in items) if s]
    clean = [d for d in first.values() if not any(5 * len(s & shingle_texts(words(d["text"]))) >= 4 * len(s) for s in held)]
    model = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    return sorted(
        (d["doc_id"], np.array(model.encode(pii.redacted(d["text"]), add_special_tokens=False).ids, "<u4").tobytes(), True) for d in clean
    )


def test_run_matches_brute_force(spark, rows):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = corpus_pipeline.run(spark, SF).select("doc_id", "ids", "exact").collect()
    expected = brute(docs, items)
    assert 0 < len(expected) < len(docs)
    assert sorted((r.doc_id, bytes(r.ids), r.exact) for r in found) == expected


def test_stages_keep_the_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("x")).withColumn("_extra", F.lit(1))
    docs = docs.withColumns({c: F.lit(c) for c in ("_language", "language", "class_key", "_class_key", "class_did", "key", "a.b")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        assert kept.where("language = 'language' AND _language = '_language' AND class_key = 'class_key' AND `a.b` = 'a.b'").count() == kept.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("lang", [None, "en"])
def test_odd_rows(spark, lang):
    shown = [(1, None), (2, ""), (3, "?! 12"), (None, "plain words only here"), (5, "plain words only here"), (5, "plain words only here"), (6, "mail me@example.org please")]
    docs = spark.createDataFrame([(d, t, lang, None, None) for d, t in shown], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    found = sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect())
    assert found == [(5, "plain words only here", 21), (6, "mail [EMAIL] please", 19)]
