"""A training corpus from raw documents: five stages over the table ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
as Parquet and reads it again for the next. Stages keep every column of their input,
whatever its name, and work on rows as they are: null and empty texts, repeated rows
and null ids are defined by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.llm import bpe, contamination, language, neardup, pii
from spoorline.llm.shipping import shipped
from spoorline.llm.text import named, unused
from spoorline.session import releasing, stored

#: A text is rejected if no language makes up this share of it: a text with quotations in
#: two other languages stays, a jumble of four or more goes.
LEAST_SHARE = 1 / 3


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and mixtures that no language leads, go.

    Without any labelled text to learn from, only texts without a letter go.
    """
    languages, model = language.train(docs.where(language.fold(F.col("doc_id")) != 2))
    if not languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predict = language.predictor(languages, model, spark)
    found = unused("language", docs)
    judged = docs.withColumn(found, predict("text"))
    kept = (F.col(f"{found}.lang") != language.UNKNOWN) & (F.col(f"{found}.score") >= LEAST_SHARE)
    return judged.where(kept).select(*named(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return docs.withColumn("text", pii.redact("text")).withColumn("n_chars", F.length("text").cast("long"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (packed, little-endian), and whether they decode to it."""
    _, _, round_trip = bpe.codec(spark, tokenizer_path())
    done = docs.select("doc_id", "lang", "source", "text", round_trip("text").alias("done"))
    return done.select(
        "doc_id",
        "lang",
        "source",
        bpe.token_count(F.col("done.ids")).alias("n_tokens"),
        F.col("done.ids").alias("ids"),
        (F.col("done.text") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


STAGES = [
    ("language", shipped(identify_language)),
    ("near_duplicates", shipped(drop_near_duplicates)),
    ("decontamination", shipped(drop_contaminated)),
    ("personal_data", shipped(redact_personal_data)),
    ("tokens", shipped(tokenise)),
]

#: The mixture model, similarity classes and merges cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with releasing(spark):  # what the stage stored on its way
            docs = stored(stage(spark, docs, sf_dir), name, kept=True)
    return STAGES[-1][1](spark, docs, sf_dir)
