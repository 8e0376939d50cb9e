"""Scoring images against species prompts, ranking and top-1 prediction.

Images carry a vector in ``embedding``; a null vector marks an unreadable image.
Prompts are a table of ``species``, ``ord`` and ``embedding``, one row per label.
"""

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline.functions.similarity import (
    best_of_prompts,
    cosine,
    cosine_to_own_prompt,
    cosine_to_prompts,
    scores_by_block,
)
from spoorline.functions.text import round4
from spoorline.operators.ranking import top_n_per_group
from spoorline.session import stored

# Prompts that are scored at once: bounds the score matrix of a batch.
BLOCK_PROMPTS = 4096
# Prompts are a table of labels, one row each, that travels with the tasks. A table
# beyond this size is no label table and is refused.
MAX_PROMPTS = 65_536


@dataclass(frozen=True)
class PromptBlock:
    species: list[str]
    ords: list[int]
    vectors: np.ndarray

    def labels(self) -> Column:
        return F.array(*[F.lit(s) for s in self.species])


Prompts = DataFrame | list[PromptBlock]


def prompt_blocks(prompts: Prompts, block_prompts: int = BLOCK_PROMPTS) -> list[PromptBlock]:
    """Read the prompt dimension in target order, in blocks of bounded size.

    The order breaks ties, so every prompt must have its own ``ord``.
    """
    if isinstance(prompts, list):
        return prompts
    rows = prompts.select("species", "ord", "embedding").orderBy("ord").limit(MAX_PROMPTS + 1).collect()
    if len(rows) > MAX_PROMPTS:
        raise ValueError(f"more than {MAX_PROMPTS} prompts")
    if len({r.ord for r in rows} - {None}) < len(rows):
        raise ValueError("prompts need an ord each, without repeats or nulls")
    parts = [rows[k : k + block_prompts] for k in range(0, len(rows), block_prompts)]
    return [
        PromptBlock(
            [r.species for r in part],
            [r.ord for r in part],
            np.array([r.embedding for r in part], dtype=np.float64),
        )
        for part in parts
    ]


def _scores(block: PromptBlock, engine: str) -> Column:
    if engine == "sql":
        return F.array(
            *[cosine("embedding", F.lit([float(v) for v in row])) for row in block.vectors]
        )
    return cosine_to_prompts(block.vectors)("embedding")


def _score_of(block: PromptBlock, species: Column) -> Column:
    """The score of one label, null when the block lacks it."""
    return F.get(F.col("_scores"), F.array_position(block.labels(), species).cast("int") - 1)


def score_all(
    images: DataFrame,
    prompts: Prompts,
    keep: list[str] | None = None,
    engine: str = "arrow",
    block_prompts: int = BLOCK_PROMPTS,
) -> DataFrame:
    """Every readable image with every prompt: ``species``, ``ord``, ``score``.

    The prompts travel with the task, so this is a projection and not a join, and the
    vectors are read once, however many blocks of prompts there are.
    """
    keep = keep or ["image_id"]
    blocks = prompt_blocks(prompts, block_prompts)
    if not blocks:
        raise ValueError("the prompt table is empty")
    readable = images.filter(F.col("embedding").isNotNull())
    if len(blocks) > 1 and engine == "arrow":
        own = readable.select(*keep, "embedding")
        score = [T.StructField("species", T.StringType()), T.StructField("ord", T.LongType()), T.StructField("score", T.DoubleType())]
        schema = T.StructType([own.schema[c] for c in keep] + score)
        parts = [(b.species, b.ords, b.vectors) for b in blocks]
        return own.mapInArrow(scores_by_block(parts, keep), schema).withColumn("ord", F.col("ord").cast("int"))
    parts = []
    for block in blocks:
        names = F.array(
            *[
                F.struct(F.lit(s).alias("species"), F.lit(o).alias("ord"))
                for s, o in zip(block.species, block.ords)
            ]
        )
        parts.append(
            readable.select(*keep, _scores(block, engine).alias("_scores"))
            .select(*keep, F.posexplode("_scores").alias("_at", "score"))
            .select(*keep, F.get(names, F.col("_at")).alias("_name"), "score")
            .select(*keep, "_name.species", "_name.ord", "score")
        )
    return reduce(DataFrame.unionAll, parts)


def top1_species(
    images: DataFrame,
    prompts: Prompts,
    engine: str = "arrow",
    wide: bool = False,
    block_prompts: int = BLOCK_PROMPTS,
) -> DataFrame:
    """Predicted species per readable image, the first in target order on ties.

    Needs ``image_id``, ``species_label`` and ``embedding``; other columns stay.
    Adds true_species, predicted_species, correct, top1_score and
    true_species_score, and with ``wide`` one score column per prompt. All of it
    is computed within the row, block by block; rows do not move or merge, so
    repeated images stay repeated.
    """
    blocks = prompt_blocks(prompts, block_prompts)
    if not blocks:
        raise ValueError("the prompt table is empty")
    rest = [c for c in images.columns if c not in ("embedding", "species_label")]
    label = F.col("species_label")
    found = images.filter(F.col("embedding").isNotNull())
    wide_columns = []
    if engine == "arrow" and not wide:
        names = [species for block in blocks for species in block.species]
        best = best_of_prompts([block.vectors for block in blocks], names)("embedding", label)
        found = found.withColumn("_best", best)
    else:
        ends = []
        for i, block in enumerate(blocks):
            found = found.withColumn("_scores", _scores(block, engine))
            at = F.array_position("_scores", F.array_max("_scores")).cast("int") - 1
            ords = F.array(*[F.lit(o) for o in block.ords])
            end = F.struct(
                F.array_max("_scores").alias("top"),
                (-F.get(ords, at)).alias("_order"),
                F.get(block.labels(), at).alias("species"),
                _score_of(block, label).alias("own"),
            )
            found = found.withColumn(f"_end_{i}", end)
            ends.append(F.col(f"_end_{i}"))
            if wide:
                for j, species in enumerate(block.species):
                    name = f"score_{species}"
                    found = found.withColumn(name, round4(F.get("_scores", F.lit(j))))
                    wide_columns.append(name)
        first = F.greatest(*ends) if len(ends) > 1 else ends[0]
        own = F.coalesce(*[end["own"] for end in ends])
        best = F.struct(first["top"].alias("top"), first["species"].alias("species"), own.alias("own"))
        found = found.withColumn("_best", best)
    return found.select(
        *rest,
        label.alias("true_species"),
        F.col("_best.species").alias("predicted_species"),
        F.coalesce(F.col("_best.species") == label, F.lit(False)).alias("correct"),
        round4("_best.top").alias("top1_score"),
        F.coalesce(round4("_best.own"), F.lit(0.0)).alias("true_species_score"),
        *wide_columns,
    )


def score_wide(scores: DataFrame, targets: list[str]) -> DataFrame:
    """Long scores turned into one rounded ``score_<species>`` column per target."""
    wide = scores.groupBy("image_id").pivot("species", targets).agg(F.first("score"))
    return wide.select("image_id", *[round4(wide[t]).alias(f"score_{t}") for t in targets])


def with_own_score(
    images: DataFrame, prompts: Prompts, species: str | Column = "species_label"
) -> DataFrame:
    """Adds ``bioclip_score``: each image against the prompt of one label.

    ``species`` names the label of each row. Unreadable images and labels without
    a prompt score 0.
    """
    label = F.col(species) if isinstance(species, str) else species
    own = []
    for block in prompt_blocks(prompts):
        at = F.array_position(block.labels(), label).cast("int") - 1
        own.append(cosine_to_own_prompt(block.vectors)("embedding", at))
    rest = [c for c in images.columns if c != "embedding"]
    return images.select(*rest, F.coalesce(*own, F.lit(0.0)).alias("bioclip_score"))


def _relative(score: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(1.0))


def minmax_confidence(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Adds ``confidence``: the score placed between the lowest and the highest.

    Without ``by`` the range is over all rows; with it, over each group. Rows
    without a group are a group of their own.
    """
    limits = [F.min("bioclip_score").alias("low"), F.max("bioclip_score").alias("high")]
    if by is None:
        ends = scored.agg(F.struct(*limits)).scalar()
        return (
            scored.withColumn("_ends", ends)
            .withColumn(
                "confidence",
                _relative(F.col("bioclip_score"), F.col("_ends.low"), F.col("_ends.high")),
            )
            .drop("_ends")
        )
    return minmax_confidence_of(scored, scored, by)


def minmax_confidence_of(rows: DataFrame, scored: DataFrame, by: str) -> DataFrame:
    """``minmax_confidence`` for some rows, with the ranges of all ``scored`` ones."""
    limits = [F.min("bioclip_score").alias("low"), F.max("bioclip_score").alias("high")]
    ranges = scored.groupBy(F.col(by).alias("_by")).agg(*limits)
    return (
        rows.join(ranges, F.col(by).eqNullSafe(F.col("_by")))
        .withColumn("confidence", _relative(F.col("bioclip_score"), F.col("low"), F.col("high")))
        .drop("low", "high", "_by")
    )


def rank_scored(scored: DataFrame, top_n: int, seq: str = "seq") -> DataFrame:
    """Top rows by score, each with its place in the range of all rows."""
    return minmax_confidence(scored).orderBy(F.desc("bioclip_score"), seq).limit(top_n)


def rank_each_scored(scored: DataFrame, top_n: int, seq: str = "seq") -> DataFrame:
    """Top rows of each label, each with its place in the range of its label.

    Only the winners meet the ranges, so the join is as small as the result.
    """
    best = top_n_per_group(scored, ["species_label"], [F.desc("bioclip_score"), F.col(seq)], top_n)
    return minmax_confidence_of(best, scored, "species_label")


def rank_by_species(
    images: DataFrame, prompts: DataFrame, species: str, top_n: int, seq: str = "seq"
) -> DataFrame:
    """Top ``top_n`` images for one species prompt, with score and confidence.

    The candidates are the given rows. The confidence range covers all of them,
    and equal scores keep table order. Scores are stored before they are ranked, so
    that the vectors are read and multiplied once.
    """
    prompt = prompts.filter(F.col("species") == species)
    scored = stored(with_own_score(images, prompt, F.lit(species)), "scores")
    return rank_scored(scored, top_n, seq)


def rank_each_species(
    images: DataFrame, prompts: DataFrame, top_n: int, seq: str = "seq"
) -> DataFrame:
    """``rank_by_species`` for all labels at once, each among its own images."""
    return rank_each_scored(stored(with_own_score(images, prompts), "scores"), top_n, seq)
