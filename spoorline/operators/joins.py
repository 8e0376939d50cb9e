"""Joins with ground truth and between evaluation results."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline import fixed_values as fixed
from spoorline.functions import measures, text
from spoorline.operators.ranking import latest


def _last_labels(truth: DataFrame, seq: str) -> DataFrame:
    labels = latest(truth, "image_id", ["species_label"], seq)
    return labels.withColumnRenamed("species_label", "_label")


def with_ground_truth(detections: DataFrame, truth: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds ground_truth_species and the verdict text ``correct``.

    The last label of an image wins. Reducing the labels to one row per image
    before the join keeps the detection rows from multiplying, and leaves a
    one-sided skew that adaptive execution splits.
    """
    kept = [c for c in detections.columns if c not in ("ground_truth_species", "correct")]
    return (
        detections.select(*kept)
        .join(_last_labels(truth, seq), "image_id", "left")
        .withColumn("correct", measures.correct_label("_label", "species"))
        .withColumn("ground_truth_species", F.coalesce("_label", F.lit(fixed.UNKNOWN)))
        .select(*kept, "ground_truth_species", "correct")
    )


def derive_correct(
    detections: DataFrame, truth: DataFrame | None = None, seq: str = "seq"
) -> DataFrame:
    """Boolean ``correct`` and ``localised`` for reading stored detections.

    A stored verdict text is used when the column is there; otherwise the label
    of the image is compared with the species it was run for.
    """
    if "correct" in detections.columns:
        out = detections.withColumn("correct", measures.is_correct("correct"))
    else:
        if truth is None:
            raise ValueError("detections without a verdict need ground truth")
        out = (
            detections.join(_last_labels(truth, seq), "image_id", "left")
            .withColumn("correct", measures.exact_match("_label", "species"))
            .drop("_label")
        )
    located = (
        measures.is_localised("location") if "location" in detections.columns else F.lit(False)
    )
    return out.withColumn("localised", located)


def enrich_ground_truth(images: DataFrame, annotations: DataFrame, seq: str = "pos") -> DataFrame:
    """Adds the citizen-scientist count and behaviour shares to the images.

    The last annotation of an image wins. Images without one get nulls; fields an
    annotation leaves out get count ``1`` and share 0.
    """
    shares = {s: g for s, g in fixed.SHARES.items() if s in annotations.columns}
    last = latest(
        annotations.filter(F.col("image_id") != ""), "image_id", ["count", *shares], seq
    ).withColumn("_matched", F.lit(True))
    matched = F.col("_matched").isNotNull()
    label = F.coalesce("count", F.lit(fixed.DEFAULT_COUNT_LABEL))
    joined = images.drop(*fixed.SHARES.values(), "ground_truth_count", "ground_truth_count_num").join(
        last, "image_id", "left"
    )
    added = {
        "ground_truth_count": F.when(matched, label),
        "ground_truth_count_num": F.when(matched, measures.count_midpoint(label)),
    }
    for share, name in fixed.SHARES.items():
        value = F.coalesce(share, F.lit(0.0)) if share in shares else F.lit(0.0)
        added[name] = F.when(matched, value)
    return joined.withColumns(added).drop("_matched", "count", *shares)


def count_truth(enriched: DataFrame) -> DataFrame:
    """Ground-truth counts as image_id, gt_count and ground_truth_count."""
    return enriched.select(
        "image_id", F.col("ground_truth_count_num").alias("gt_count"), "ground_truth_count"
    )


def count_errors(
    detections: DataFrame, truth: DataFrame, dedupe: bool = False, seq: str | None = None
) -> DataFrame:
    """Detections with their count error and exact-match flag.

    Repeated images in ``truth`` repeat the detection, as in a plain left join;
    ``dedupe`` keeps the last row by ``seq`` instead.
    """
    columns = ["gt_count", "ground_truth_count"]
    if dedupe:
        if seq is None:
            raise ValueError("dedupe needs the column that orders the rows")
        truth = latest(truth, "image_id", columns, seq)
    return detections.join(truth.select("image_id", *columns), "image_id", "left").withColumns(
        {
            "count_error": measures.count_error("instance_count", "gt_count"),
            "exact_match": measures.exact_match("instance_count", "gt_count"),
        }
    )


def combine_identification_localisation(
    identification: DataFrame, localisation: DataFrame, seq: str
) -> DataFrame:
    """Identified images with the localisation result, and whether both hold.

    Both sides are keyed by image: where an image repeats, the row with the highest
    ``seq`` of its side counts. Rows without an image id are left out.
    """
    columns = ["megadetector_localised", "megadetector_quality", "megadetector_backend"]
    kept = [c for c in identification.columns if c not in ("image_id", seq)]
    identified = latest(identification, "image_id", kept, seq)
    found = latest(localisation, "image_id", columns, seq)
    return identified.join(found, "image_id", "left").withColumns(
        {
            "megadetector_localised": F.coalesce("megadetector_localised", F.lit(False)),
            "megadetector_quality": F.coalesce("megadetector_quality", F.lit(0.0)),
            "megadetector_backend": F.coalesce("megadetector_backend", F.lit("unknown")),
            "combined_correct": F.col("bioclip_correct")
            & F.coalesce("megadetector_localised", F.lit(False)),
        }
    )


def overlays_by_image(
    detections: DataFrame,
    pipelines: list[str] = fixed.PIPELINE_ORDER,
    base: str = fixed.PIPELINE_ORDER[0],
    seq: str = "seq",
) -> DataFrame:
    """First overlay path of each pipeline, for the images the base pipeline has."""
    base_rows = F.count_if(F.col("pipeline") == base)
    firsts = [
        F.min_by(F.when(F.col("pipeline") == p, F.col("overlay_path")),
                 F.when(F.col("pipeline") == p, F.col(seq))).alias(p)
        for p in pipelines
    ]
    return (
        detections.groupBy("image_path")
        .agg(base_rows.alias("_base"), *firsts)
        .filter(F.col("_base") > 0)
        .withColumn("compare_name", F.concat(text.file_stem("image_path"), F.lit("_compare.jpg")))
        .drop("_base")
    )


def with_display_names(df: DataFrame, species: str = "species") -> DataFrame:
    """Adds display name, concept prompt and colour of a label column."""
    return df.withColumns(
        {
            "display_name": text.pretty_species(species),
            "concept_prompt": text.concept_prompt(species),
            "colour": text.species_colour(species),
        }
    )


def with_pipeline_names(df: DataFrame) -> DataFrame:
    """Adds the shown label and output text of the pipeline column."""
    return df.withColumns(
        {
            "pipeline_label": text.pipeline_label("pipeline"),
            "pipeline_output": text.pipeline_output("pipeline"),
        }
    )
