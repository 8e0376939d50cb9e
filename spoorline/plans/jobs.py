"""Whole jobs: detection, comparison, evaluation, counting and enrichment.

Jobs take and return DataFrames; the sinks in ``spoorline.sources.sinks`` store
what they return. Images carry ``seq`` (table order) and ``embedding``.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spoorline import fixed_values as fixed
from spoorline.functions import measures, text
from spoorline.operators import aggregates, filters, joins, reports, sets
from spoorline.operators.models import pipeline as registered
from spoorline.operators.similarity import (
    prompt_blocks,
    rank_each_scored,
    rank_scored,
    top1_species,
    with_own_score,
)
from spoorline.session import releasing, stored
from spoorline.sources import sinks, tables


def select_images(
    images: DataFrame, prompts: DataFrame, species: str, top_n: int, seq: str = "seq"
) -> DataFrame:
    """Top images of a label, without the unreadable ones that only filled a place.

    The vectors, by far the widest column, are read once: scores are stored and
    ranked from there. The selection is stored too, since every later step of a
    detection run starts from it.
    """
    candidates = filters.filter_species(_marked(images), species)
    prompt = prompts.filter(F.col("species") == species)
    scored = stored(with_own_score(candidates, prompt, F.lit(species)), "scores")
    return stored(_readable(rank_scored(scored, top_n, seq)), "selection")


def select_images_of_each(
    images: DataFrame, prompts: DataFrame, top_n: int, seq: str = "seq"
) -> DataFrame:
    """``select_images`` for every label at once, each among its own images."""
    scored = stored(with_own_score(_marked(images), prompts), "scores")
    return stored(_readable(rank_each_scored(scored, top_n, seq)), "selection")


def _marked(images: DataFrame) -> DataFrame:
    return images.withColumn("_readable", F.col("embedding").isNotNull())


def _readable(ranked: DataFrame) -> DataFrame:
    return ranked.filter("_readable").drop("_readable")


def judge(selected: DataFrame, truth: DataFrame, species: str | Column) -> DataFrame:
    """The selection with the label it is run for, its true label and the verdict.

    ``truth`` holds the labels (image_id, species_label, seq) of the whole dataset.
    It is cut to the selection first, which is small next to it and, being stored,
    has a known size to plan by.
    """
    label = F.lit(species) if isinstance(species, str) else species
    known = truth.join(selected.select("image_id"), "image_id", "left_semi")
    return joins.with_ground_truth(selected.withColumn("species", label), known)


def localise_in(
    judged: DataFrame, pipeline: str, raw: DataFrame, results_root: str = "results"
) -> DataFrame:
    """Detection records of one pipeline for a judged selection.

    ``raw`` is the detector output; boxes of other images are dropped first.
    """
    found = raw.join(judged.select("image_id"), "image_id", "left_semi")
    located = registered(pipeline).localise(judged, found)
    return filters.to_detection_records(located, pipeline, F.col("species"), results_root)


def detect(
    images: DataFrame,
    prompts: DataFrame,
    raw: DataFrame,
    truth: DataFrame,
    pipeline: str,
    species: str,
    top_n: int = fixed.DEFAULT_TOP_N,
    results_root: str = "results",
) -> DataFrame:
    """One pipeline on one label: rank, localise, judge, make records."""
    selected = select_images(images, prompts, species, top_n)
    return localise_in(judge(selected, truth, species), pipeline, raw, results_root)


def detect_all_species(
    images: DataFrame,
    prompts: DataFrame,
    raw: DataFrame,
    truth: DataFrame,
    pipeline: str,
    top_n: int = fixed.DEFAULT_TOP_N,
    results_root: str = "results",
) -> DataFrame:
    """``detect`` for every label at once, each label among its own images."""
    selected = select_images_of_each(images, prompts, top_n)
    judged = judge(selected, truth, F.col("species_label"))
    return localise_in(judged, pipeline, raw, results_root)


def detect_stored(
    spark: SparkSession,
    images_path: str,
    vectors: DataFrame,
    prompts: DataFrame,
    raw: DataFrame,
    pipeline: str,
    species: str,
    output: str,
    fmt: str = "csv",
    top_n: int = fixed.DEFAULT_TOP_N,
    files: DataFrame | None = None,
    root: str = "",
    directories: Sequence[str] = (),
) -> DataFrame:
    """One pipeline on one label from stored metadata to stored detections.

    ``vectors`` holds image_id and embedding; an image without one is unreadable. Paths
    are resolved when a file listing is given. Rows count in the order of the files. A
    label without images writes nothing. Returns what was stored.
    """
    every = tables.read_images(spark, images_path, fmt, ordered=True)
    images = tables.read_species(
        spark, images_path, species, files, root, directories, fmt, ordered=True
    )
    images = images.join(vectors.select("image_id", "embedding"), "image_id", "left")
    truth = every.select("image_id", "species_label", "seq")
    with releasing(spark):
        found = detect(images, prompts, raw, truth, pipeline, species, top_n)
        sinks.write_detections(found, output)
    return tables.read_detections(spark, output, pipeline, species)


@dataclass(frozen=True)
class Comparison:
    detections: DataFrame
    metrics: DataFrame
    overlays: DataFrame
    report: DataFrame


def compare_pipelines(
    images: DataFrame,
    prompts: DataFrame,
    raw: dict[str, DataFrame],
    truth: DataFrame,
    runs: DataFrame,
    species: str,
    top_n: int = fixed.DEFAULT_TOP_N,
    results_root: str = "results",
) -> Comparison:
    """The pipelines in ``raw`` on the same images, side by side.

    The images are ranked and judged once; the selection feeds every pipeline.
    """
    selected = select_images(images, prompts, species, top_n)
    judged = stored(judge(selected, truth, species), "judged")
    parts = [localise_in(judged, name, found, results_root) for name, found in raw.items()]
    # stored, so that metrics, overlays and page do not locate everything again
    detections = stored(sets.union_pipelines(parts), "detections")
    metrics = aggregates.pipeline_comparison(detections, runs)
    return Comparison(
        detections,
        metrics,
        joins.overlays_by_image(detections, seq="detection_id"),
        reports.comparison_report(metrics, species),
    )


def compare_stored(
    spark: SparkSession,
    images_path: str,
    vectors: DataFrame,
    prompts: DataFrame,
    raw: dict[str, DataFrame],
    runs: DataFrame,
    species: str,
    output: str,
    fmt: str = "csv",
    top_n: int = fixed.DEFAULT_TOP_N,
) -> Comparison:
    """The comparison from stored metadata to its stored outputs.

    Under ``output`` go ``detections`` (by pipeline and species), ``merged`` (the union as
    CSV) and ``report`` (the page). What is returned reads them; the job's scratch tables
    are gone.
    """
    images = tables.read_images(spark, images_path, fmt, ordered=True)
    images = images.join(vectors.select("image_id", "embedding"), "image_id", "left")
    truth = images.select("image_id", "species_label", "seq")
    place = output.rstrip("/")
    with releasing(spark):
        done = compare_pipelines(images, prompts, raw, truth, runs, species, top_n)
        sinks.write_detections(done.detections, f"{place}/detections")
    found = tables.read_detections(spark, f"{place}/detections", species=species)
    found = found.filter(F.col("pipeline").isin(list(raw)))
    metrics = aggregates.pipeline_comparison(found, runs)
    page = reports.comparison_report(metrics, species)
    sinks.write_merged(found, f"{place}/merged")
    sinks.write_report(page, f"{place}/report")
    return Comparison(found, metrics, joins.overlays_by_image(found, seq="detection_id"), page)


@dataclass(frozen=True)
class Evaluation:
    rows: DataFrame
    accuracy: DataFrame
    by_species: DataFrame
    confusions: DataFrame
    report: DataFrame


def evaluation_rows(
    images: DataFrame,
    prompts: DataFrame,
    files: DataFrame | None = None,
    per_species: int | None = None,
    wide: bool = True,
    root: str = "",
    directories: Sequence[str] = (),
) -> DataFrame:
    """Predicted and true label of each image of a prompted label.

    With ``files``, paths are resolved in the listing, from ``root`` and in
    ``directories``, and images that are not in it are left out; ``per_species`` keeps
    the first images of each label, missing ones counted. Labels without an image get
    no prompt either.
    """
    return _evaluated(images, prompts, files, per_species, wide, root, directories).drop("seq")


def _evaluated(
    images: DataFrame,
    prompts: DataFrame,
    files: DataFrame | None,
    per_species: int | None,
    wide: bool,
    root: str,
    directories: Sequence[str],
) -> DataFrame:
    """Evaluation rows with ``seq``: target order of the label, then table order."""
    present = images.select(F.col("species_label").alias("species")).distinct()
    used = prompt_blocks(prompts.join(present, "species", "left_semi"))
    labels = [species for block in used for species in block.species]
    chosen = sets.concat_species(images, labels, per_species)
    chosen = filters.with_defaults(
        chosen, {"site_id": "", "latitude": 0.0, "longitude": 0.0, "local_image_path": ""}
    )
    target = F.array_position(F.array(*[F.lit(s) for s in labels]), F.col("species_label"))
    needed = chosen.select(
        "image_id",
        F.struct(target.alias("target"), F.col("seq")).alias("seq"),
        F.col("local_image_path"),
        "species_label",
        F.col("site_id").alias("camera_id"),
        "latitude",
        "longitude",
        "embedding",
    )
    top = top1_species(needed, used, wide=wide)
    if files is not None:
        # After scoring, so that the joins move no vectors.
        top = filters.resolve_paths(top, files, root, directories)
        top = filters.keep_existing(top, files)
    order = [
        "image_id",
        F.col("local_image_path").alias("image_path"),
        "true_species",
        "predicted_species",
        "correct",
        "top1_score",
        "true_species_score",
        "camera_id",
        "latitude",
        "longitude",
    ]
    return top.select(*order, *[c for c in top.columns if c.startswith("score_")], "seq")


def summarise_evaluation(
    rows: DataFrame, targets: Sequence[str], source: str = ""
) -> Evaluation:
    """Accuracy, per-label accuracy, confusions and the page, from evaluation rows.

    The rows are read once, for a stored tally that every summary is made from. To keep
    the rows as well, store them first and pass what is read back.
    """
    counts = stored(aggregates.tally(rows), "tally")
    accuracy = aggregates.top1_accuracy_from(counts)
    by_species = aggregates.per_species_accuracy_from(counts)
    confused = aggregates.confusions_from(counts)
    page = reports.evaluation_report(accuracy, by_species, confused, targets, source)
    return Evaluation(rows, accuracy, by_species, confused, page)


def evaluate_stored(
    spark: SparkSession,
    images_path: str,
    vectors: DataFrame,
    prompts: DataFrame,
    output: str,
    fmt: str = "csv",
    per_species: int | None = None,
    files: DataFrame | None = None,
    root: str = "",
    directories: Sequence[str] = (),
) -> Evaluation:
    """The evaluation from stored metadata to stored rows, summarised from what was stored.

    ``vectors`` holds image_id and embedding. The first images of a label are those that
    stand first in the files.
    """
    images = tables.read_images(spark, images_path, fmt, ordered=True)
    images = images.join(vectors.select("image_id", "embedding"), "image_id", "left")
    rows = evaluation_rows(images, prompts, files, per_species, False, root, directories)
    sinks.write_evaluation(rows, output)
    targets = [species for block in prompt_blocks(prompts) for species in block.species]
    return summarise_evaluation(tables.read_evaluation(spark, output), targets, output)


@dataclass(frozen=True)
class ModelEvaluation:
    rows: DataFrame
    metrics: DataFrame
    by_species: DataFrame
    confusions: DataFrame
    report: DataFrame


def model_rows(
    images: DataFrame,
    prompts: DataFrame,
    localisation: DataFrame,
    files: DataFrame | None = None,
    per_species: int | None = None,
    root: str = "",
    directories: Sequence[str] = (),
) -> DataFrame:
    """Identification and localisation of each image, one row an image.

    ``localisation`` has image_id, seq, has_mask, quality and backend: the outcome of
    the segmenter that was given the true label. Of an image's repeated rows the last
    one counts, on either side.
    """
    scored = _evaluated(images, prompts, files, per_species, False, root, directories)
    identified = scored.select(
        "image_id",
        "image_path",
        "true_species",
        F.col("predicted_species").alias("bioclip_predicted"),
        F.col("correct").alias("bioclip_correct"),
        F.col("top1_score").alias("bioclip_score"),
        F.col("true_species_score").alias("bioclip_true_score"),
        "seq",
    )
    found = localisation.select(
        "image_id",
        measures.mask_localised("has_mask", "quality").alias("megadetector_localised"),
        text.round4("quality").alias("megadetector_quality"),
        F.col("backend").alias("megadetector_backend"),
        "seq",
    )
    return joins.combine_identification_localisation(identified, found, "seq")


def summarise_models(
    rows: DataFrame, targets: Sequence[str], runs: DataFrame | None = None
) -> ModelEvaluation:
    """Rates of both models and of their agreement, from one reading of model rows."""
    flags = list(aggregates.STAGE_FLAGS.values())
    counts = stored(aggregates.tally(rows, "bioclip_predicted", "bioclip_correct", flags), "tally")
    metrics = aggregates.model_comparison_from(counts, runs)
    by_species = aggregates.model_comparison_by_species_from(counts)
    confused = aggregates.confusions_from(counts, fixed.COMPARISON_CONFUSIONS)
    page = reports.model_report(metrics, by_species, confused, targets)
    return ModelEvaluation(rows, metrics, by_species, confused, page)


def models_stored(
    spark: SparkSession,
    images_path: str,
    vectors: DataFrame,
    prompts: DataFrame,
    localisation: DataFrame,
    output: str,
    fmt: str = "csv",
    runs: DataFrame | None = None,
    per_species: int | None = None,
    files: DataFrame | None = None,
    root: str = "",
    directories: Sequence[str] = (),
) -> ModelEvaluation:
    """The model comparison from stored metadata to stored rows and page.

    ``vectors`` and the order of images as in ``evaluate_stored``. Under ``output``, ``rows``
    holds the comparison's rows and ``report`` its page.
    """
    images = tables.read_images(spark, images_path, fmt, ordered=True)
    images = images.join(vectors.select("image_id", "embedding"), "image_id", "left")
    rows = model_rows(images, prompts, localisation, files, per_species, root, directories)
    sinks.write_model_comparison(rows, f"{output}/rows", "parquet")
    targets = [species for block in prompt_blocks(prompts) for species in block.species]
    done = summarise_models(tables.read_comparison(spark, f"{output}/rows"), targets, runs)
    sinks.write_report(done.report, f"{output}/report")
    return done


@dataclass(frozen=True)
class CountEvaluation:
    rows: DataFrame
    accuracy: DataFrame
    report: DataFrame


def evaluate_counts(detections: DataFrame, enriched: DataFrame, species: str) -> CountEvaluation:
    """Counting accuracy of every pipeline on the detections of one label.

    ``rows`` repeats a detection for each truth row of its image; the accuracy is
    the same as over those rows but does not need them.
    """
    filters.require_columns(enriched, ["image_id", "ground_truth_count_num"])
    filters.require_columns(detections, ["image_id", "instance_count"])
    chosen = detections.filter(F.col("species") == species)
    truth = joins.count_truth(enriched)
    accuracy = aggregates.count_accuracy_from(chosen, truth)
    page = reports.count_report(accuracy, species)
    return CountEvaluation(joins.count_errors(chosen, truth), accuracy, page)


def evaluate_all_counts(detections: DataFrame, enriched: DataFrame) -> DataFrame:
    """Counting accuracy per label and pipeline in one pass over all labels."""
    truth = joins.count_truth(enriched)
    return aggregates.count_accuracy_from(detections, truth, ("species", "pipeline"))


@dataclass(frozen=True)
class Enrichment:
    images: DataFrame
    match_rate: DataFrame
    distribution: DataFrame


def enrich_stored(
    spark: SparkSession,
    images_path: str,
    annotations_path: str,
    fmt: str = "csv",
    lines: bool = False,
) -> Enrichment:
    """From stored metadata and annotation documents to the next version of the metadata.

    Images and annotations are read once: matches are counted while the new version is
    written, and the common counts come from its one column. Returns what was stored.
    """
    images = tables.read_images(spark, images_path, fmt)
    enriched = joins.enrich_ground_truth(images, tables.read_annotations(spark, annotations_path, lines))
    watch = Observation()
    matched = F.count("ground_truth_count").alias("matched")
    sinks.write_enriched_images(enriched.observe(watch, matched, F.count("*").alias("total")), images_path, fmt)
    found = spark.range(1).select(*[F.lit(watch.get[c]).cast("long").alias(c) for c in ("matched", "total")])
    rate = found.withColumn("match_pct", measures.rate_pct(F.col("matched"), F.col("total")))
    done = tables.read_images(spark, images_path, fmt, enriched=True)
    return Enrichment(done, rate, aggregates.count_distribution(done))


def enrich_images(images: DataFrame, annotations: DataFrame, seq: str = "pos") -> Enrichment:
    """Images with ground-truth counts, how many matched, and the common counts."""
    enriched = joins.enrich_ground_truth(images, annotations, seq)
    return Enrichment(
        enriched, aggregates.match_rate(enriched), aggregates.count_distribution(enriched)
    )
