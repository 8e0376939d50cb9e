"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from spoorline.llm.shipping import shipped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(function: Callable[[SparkSession, str], DataFrame]):
    """Registers a query under the function's name."""
    QUERIES[function.__name__] = shipped(function)
    return function


def tokenizer_path(name: str) -> str:
    """The place of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import bpe

    _, _, round_trip = bpe.codec(spark, tokenizer_path("byte_bpe_50k.json"))
    docs = table(spark, sf_dir, "documents").select("doc_id", round_trip("text").alias("done"))
    return docs.select(
        "doc_id",
        bpe.token_count(F.col("done.ids")).alias("n_tokens"),
        F.sha2("done.ids", 256).alias("ids_sha256"),
        F.sha2("done.text", 256).alias("decoded_sha256"),
    )


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import pii

    found = table(spark, sf_dir, "documents").select("doc_id", pii.spans("text").alias("found"))

    def listed(which):
        shown = F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.concat_ws(",", shown)

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(listed(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predict = language.learned(docs)
    found = docs.select("doc_id", predict("text").alias("found"))
    return found.select(
        "doc_id",
        (language.fold(F.col("doc_id")) == 2).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import contamination

    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS_SQL = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
ORACLES["op7_decontaminate"] = f"""
WITH i AS (SELECT item_id, w, least(len(w), 5) AS n FROM (SELECT DISTINCT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
     b AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS shingle FROM i),
     widths AS (SELECT DISTINCT n FROM i),
     d AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS shingle
           FROM (SELECT doc_id, {_WORDS_SQL} AS w FROM documents), widths),
     sizes AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
     shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (n, shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item FROM shared JOIN sizes USING (item_id) WHERE 5 * n_shared >= 4 * n_item
"""


@query
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import shards

    placed = shards.by_bytes(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import topk

    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors.where(F.col("vec_id") % 100 == 0), vectors, 10)


ORACLES["op1_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
           FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
     s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""


@query
def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import neardup

    return neardup.classified(table(spark, sf_dir, "documents"))


@query
def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import backoff

    docs = table(spark, sf_dir, "documents")
    return backoff.scored(docs, backoff.fold(F.col("doc_id")) == 2)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import viterbi

    count = viterbi.counter(spark, viterbi.read_pieces(tokenizer_path("piece_bpe_32k.model")))
    docs = table(spark, sf_dir, "documents").select("doc_id", count("text").alias("found"))
    return docs.select("doc_id", "found.n_tokens", "found.n_unknown", "found.score")


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import secrets

    return secrets.judged(table(spark, sf_dir, "documents"))


@query
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import runs

    seed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    found = table(spark, sf_dir, "documents").select("doc_id", runs.analysed("text", seed).alias("found"))
    found = found.select("doc_id", "found.runs", "found.collapsed")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import packing

    cut = packing.pieces(spark, tokenizer_path("byte_bpe_50k.json"), "text")
    digested = F.transform(
        cut,
        lambda p: F.struct(p["piece"].alias("piece"), p["start"].alias("start"), p["length"].alias("length"), F.crc32(p["ids"]).alias("ids_crc32")),
    )
    return packing.sequences(table(spark, sf_dir, "documents").select("doc_id", F.inline(digested)))


@query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spoorline.llm import repair

    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.summaries(repair.segments(rows))
