import numpy as np
import pandas as pd
import pyarrow as pa

import corpus_pipeline
from spoorline.llm import bpe, contamination, language, neardup, pii
from spoorline.llm.text import ROWS_AT_ONCE, sliced

TEXTS = [None, "", "mail to a@b.org or call +44 20 7946 0958", *(f"word{i} of a text that has number {i} in it" for i in range(1200))]


def test_column_functions_never_hold_a_whole_batch(spark):
    logs = np.log(np.full((2, language.BUCKETS), 1 / language.BUCKETS, np.float32))
    item = spark.createDataFrame([(7, TEXTS[9])], "item_id long, text string")
    functions = {
        "bands": neardup.bands,
        "spans": pii.spans,
        "redact": pii.redact,
        "predict": language.predictor(["aa", "bb"], logs, spark),
        "held": contamination._holder(item.collect(), contamination.hit_type(item), spark, 0.8),
        "round_trip": bpe.codec(spark, corpus_pipeline.tokenizer_path())[2],
    }
    found = {}
    for name, function in functions.items():
        parts = [*function.func(iter([pa.array(TEXTS), pa.array(["last"])]))]
        assert max(map(len, parts)) <= ROWS_AT_ONCE, name
        found[name] = [row for part in parts for row in part.to_pylist()]
        assert len(found[name]) == len(TEXTS) + 1, name
    assert found["redact"] == [*map(pii.redacted, TEXTS), "last"]
    assert found["held"][9] == [{"item_id": 7, "n_shared": 6, "n_item": 6}] and not found["held"][0]
    assert [r["text"] for r in found["round_trip"]] == [*(t or "" for t in TEXTS), "last"]
    assert found["predict"][0] == {"lang": language.UNKNOWN, "score": 0.0, "shares": []}
    # as Spark runs them: one batch of all rows gives a row each, null and empty ones too
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string").coalesce(1)
    rows = docs.select("doc_id", neardup.bands("text").alias("b"), pii.redact("text").alias("r")).collect()
    assert [(r.b, r.r) for r in sorted(rows)] == list(zip(found["bands"], found["redact"]))[:-1]


def test_slices_of_record_batches():
    batch = pa.record_batch([pa.array(range(600)), pa.array(["x"] * 600)], names=["a", "b"])
    parts = [*sliced(iter([batch, batch.slice(0, 0)]))]
    assert [len(p) for p in parts] == [256, 256, 88] and parts[2][-1] == {"a": 599, "b": "x"}


def test_linking_remembers_a_bounded_number_of_shingles(monkeypatch):
    texts = [" ".join(f"{g}w{k}" for k in range(200)) + f" end{i}" for g in range(4) for i in range(6)]
    rows = pd.DataFrame({"key": [bytes([i]) for i in range(24)], "text": texts, "label": [bytes([i]) for i in range(24)]})
    rows = rows.assign(band=1, left=0, right=0, block=0, bands=[[1, 2]] * 24)
    expected = neardup._linker(0.8)(rows)
    assert len(expected) == 20
    sizes, weighted = [], neardup.weighted
    monkeypatch.setattr(neardup, "weighted", lambda t: sizes.append(1) or weighted(t))
    monkeypatch.setattr(neardup, "SHINGLES_AT_ONCE", 700)
    assert neardup._linker(0.8)(rows).equals(expected)
    assert len(sizes) > len(texts)  # it forgot some and read them again
