"""Counts, rates, confusions, distributions and side-by-side comparisons.

Group keys here are labels, pipelines or sites, of which one may hold most rows;
every aggregate therefore reduces inside the map task before it shuffles.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline import fixed_values as fixed
from spoorline.functions import measures, text
from spoorline.operators.filters import pipeline_dim
from spoorline.session import stored


def species_counts(images: DataFrame) -> DataFrame:
    counts = images.groupBy("species_label").agg(F.count("*").alias("images"))
    return counts.orderBy(F.desc("images"), "species_label")


def available_species(rows: DataFrame, column: str = "species_label") -> DataFrame:
    """Sorted distinct labels."""
    return rows.select(F.col(column).alias("species")).dropna().distinct().orderBy("species")


def count_distribution(images: DataFrame, top: int = fixed.COUNT_LABELS_SHOWN) -> DataFrame:
    """The most frequent ground-truth count labels."""
    return (
        images.filter(F.col("ground_truth_count").isNotNull())
        .groupBy("ground_truth_count")
        .agg(F.count("*").alias("images"))
        .orderBy(F.desc("images"), "ground_truth_count")
        .limit(top)
    )


def match_rate(enriched: DataFrame) -> DataFrame:
    """How many images found an annotation."""
    matched = F.count(F.col("ground_truth_count"))
    return enriched.agg(
        matched.alias("matched"),
        F.count("*").alias("total"),
        measures.rate_pct(matched, F.count("*")).alias("match_pct"),
    )


def dataset_overview(images: DataFrame, detections: DataFrame) -> DataFrame:
    """Images, labels and sites of the dataset; accuracy and pipelines of the runs.

    Two distinct counts in one aggregate would repeat every row, so rows are first
    reduced to their (label, site) pairs.
    """
    pairs = images.groupBy("species_label", "site_id").agg(F.count("*").alias("n"))
    totals = pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("images"),
        F.count_distinct("species_label").alias("species"),
        F.count_distinct("site_id").alias("sites"),
    )
    runs = detections.groupBy("pipeline").agg(
        F.count_if("correct").alias("good"), F.count("*").alias("n")
    )
    accuracy = runs.agg(
        F.try_divide(F.sum("good") * 100.0, F.sum("n")).alias("accuracy_pct"),
        F.count("*").alias("pipelines_run"),
    )
    found = F.struct("accuracy_pct", "pipelines_run")
    return totals.withColumn("_runs", accuracy.select(found).scalar()).select(
        "images", "species", "sites", "_runs.accuracy_pct", "_runs.pipelines_run"
    )


def tally(
    rows: DataFrame,
    predicted: str = "predicted_species",
    correct: str = "correct",
    flags: Sequence[str] = (),
) -> DataFrame:
    """Images of each pair of true and predicted label, how many are wrong, and the flags' counts.

    All that the rates and confusions below need, in one pass over the rows. Store it and
    hand it to the functions that end in ``_from``. A flag comes with how often it is true
    and, as ``<flag>_known``, how often it is not null.
    """
    counts = [F.count("*").alias("images"), F.count_if(~F.col(correct)).alias("wrong")]
    for flag in dict.fromkeys([correct, *flags]):
        counts += [F.count_if(flag).alias(flag), F.count(flag).alias(f"{flag}_known")]
    return rows.groupBy("true_species", F.col(predicted).alias("predicted_species")).agg(*counts)


def _total(count: str) -> Column:
    return F.coalesce(F.sum(count), F.lit(0).cast("bigint"))


def top1_accuracy(evaluation: DataFrame) -> DataFrame:
    return _accuracy(evaluation, F.count("*"), F.count_if("correct"))


def top1_accuracy_from(tallied: DataFrame) -> DataFrame:
    """``top1_accuracy`` of the rows that were tallied."""
    return _accuracy(tallied, _total("images"), _total("correct"))


def _accuracy(rows: DataFrame, images: Column, good: Column) -> DataFrame:
    return rows.agg(
        images.alias("total"),
        good.alias("correct"),
        measures.rate_pct(good, images).alias("accuracy_pct"),
    )


def per_species_accuracy(evaluation: DataFrame, correct: str | None = None) -> DataFrame:
    """Accuracy per true label, best first, with the pass flag."""
    if correct is None:
        correct = "bioclip_correct" if "bioclip_correct" in evaluation.columns else "correct"
    good = F.count_if(correct) if correct in evaluation.columns else F.lit(0).cast("bigint")
    return _accuracy_by_species(evaluation, F.count("*"), good)


def per_species_accuracy_from(tallied: DataFrame, correct: str = "correct") -> DataFrame:
    """``per_species_accuracy`` of the rows that were tallied."""
    return _accuracy_by_species(tallied, _total("images"), _total(correct))


def _accuracy_by_species(rows: DataFrame, images: Column, good: Column) -> DataFrame:
    rate = measures.rate_pct(good, images)
    return (
        rows.groupBy(F.col("true_species").alias("species"))
        .agg(
            images.alias("images"),
            good.alias("correct"),
            text.round_exact(rate, 1).alias("accuracy_pct"),
            (rate >= fixed.PASS_MARK_PCT).alias("passed"),
        )
        .filter(F.col("species").isNotNull())
        .withColumn("display_name", text.pretty_species("species"))
        .select("species", "display_name", "images", "correct", "accuracy_pct", "passed")
        .orderBy(F.desc("accuracy_pct"), "species")
    )


def confusions(
    evaluation: DataFrame,
    top: int = fixed.EVALUATION_CONFUSIONS,
    predicted: str = "predicted_species",
    correct: str = "correct",
) -> DataFrame:
    """Most frequent wrong predictions as true label, predicted label and count."""
    wrong = (
        evaluation.filter(~F.col(correct))
        .groupBy("true_species", F.col(predicted).alias("predicted_species"))
        .agg(F.count("*").alias("times"))
    )
    return _most_frequent(wrong, top)


def confusions_from(tallied: DataFrame, top: int = fixed.EVALUATION_CONFUSIONS) -> DataFrame:
    """``confusions`` of the rows that were tallied."""
    wrong = tallied.filter("wrong > 0")
    return _most_frequent(
        wrong.select("true_species", "predicted_species", F.col("wrong").alias("times")), top
    )


def _most_frequent(wrong: DataFrame, top: int) -> DataFrame:
    return wrong.orderBy(F.desc("times"), "true_species", "predicted_species").limit(top)


def count_accuracy(errors: DataFrame) -> DataFrame:
    """Mean counts, mean absolute error and exact matches per pipeline.

    Images without a truth stay out of the error but count as not exact.
    """
    return errors.groupBy("pipeline").agg(
        F.avg("instance_count").alias("mean_count"),
        F.avg("gt_count").alias("mean_gt"),
        F.avg("count_error").alias("mae"),
        (measures.mean_flag("exact_match") * 100.0).alias("exact_pct"),
    )


def count_accuracy_from(
    detections: DataFrame, truth: DataFrame, by: Sequence[str] = ("pipeline",)
) -> DataFrame:
    """``count_accuracy`` over the joined rows without building them all.

    Images repeated on both sides multiply in the join. Here the truth is first
    reduced to the distinct counts of each image with a weight; there are only a
    dozen count labels, so a detection meets a dozen rows at most.
    """
    weighted = truth.groupBy("image_id", "gt_count").agg(F.count("*").alias("_m"))
    joined = (
        detections.select(*by, "image_id", "instance_count")
        .join(weighted, "image_id", "left")
        .withColumn("_w", F.coalesce("_m", F.lit(1)))
    )
    error = F.abs(F.col("instance_count") - F.col("gt_count"))
    exact = measures.exact_match("instance_count", "gt_count")

    def mean(value: Column) -> Column:
        whole = F.sum(F.when(value.isNotNull(), F.col("_w")))
        return F.try_divide(F.sum(value * F.col("_w")).cast("double"), whole)

    return joined.groupBy(*by).agg(
        mean(F.col("instance_count")).alias("mean_count"),
        mean(F.col("gt_count")).alias("mean_gt"),
        mean(error).alias("mae"),
        (mean(exact.cast("int")) * 100.0).alias("exact_pct"),
    )


def pipeline_comparison(detections: DataFrame, runs: DataFrame) -> DataFrame:
    """All registered pipelines side by side, also those without rows.

    Both sides of the join are as short as the registry.
    """
    known = F.col("pipeline").isin(fixed.PIPELINE_ORDER)
    metrics = (
        detections.filter(known)
        .groupBy("pipeline")
        .agg(
            F.count("*").alias("processed"),
            F.count_if(measures.is_localised("location")).alias("localised"),
            F.avg("confidence").alias("mean_confidence"),
            F.avg("detection_quality").alias("mean_quality"),
        )
    )
    seconds = runs.filter(known).groupBy("pipeline").agg(F.max("elapsed_s").alias("elapsed_s"))
    return (
        pipeline_dim(detections.sparkSession)
        .join(F.broadcast(metrics), "pipeline", "left")
        .join(F.broadcast(seconds), "pipeline", "left")
        .withColumns(
            {
                "processed": F.coalesce("processed", F.lit(0)),
                "localised": F.coalesce("localised", F.lit(0)),
                "elapsed_s": F.coalesce("elapsed_s", F.lit(0.0)),
            }
        )
        .withColumn(
            "seconds_per_image", measures.per_image_seconds(F.col("elapsed_s"), F.col("processed"))
        )
        .drop("pipeline_output")
    )


def pipeline_cards(detections: DataFrame) -> DataFrame:
    """Rows, localised rows and mean quality of each pipeline that ran."""
    return (
        detections.groupBy("pipeline")
        .agg(
            F.count("*").alias("processed"),
            F.count_if(measures.is_localised("location")).alias("localised"),
            F.avg("detection_quality").alias("mean_quality"),
        )
        .withColumn("pipeline_label", text.pipeline_label("pipeline"))
        .withColumn("pipeline_output", text.pipeline_output("pipeline"))
    )


#: Column that tells whether a stage of the model comparison was right about an image.
STAGE_FLAGS = {
    "identification": "bioclip_correct",
    "localisation": "megadetector_localised",
    "combined": "combined_correct",
}


def model_comparison(combined: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Identification, localisation and both: correct images, rate and runtime.

    ``runs`` names its stages ``identification`` and ``localisation``.
    """
    hits = [F.count_if(column).alias(stage) for stage, column in STAGE_FLAGS.items()]
    return _stages(combined.agg(F.count("*").alias("images"), *hits), runs)


def model_comparison_from(tallied: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """``model_comparison`` of the rows that were tallied with the stages' flags."""
    hits = [_total(column).alias(stage) for stage, column in STAGE_FLAGS.items()]
    return _stages(tallied.agg(_total("images").alias("images"), *hits), runs)


def _stages(parts: DataFrame, runs: DataFrame | None) -> DataFrame:
    flags = STAGE_FLAGS
    long = parts.unpivot("images", list(flags), "stage", "correct").withColumn(
        "rate_pct", F.try_divide(F.col("correct") * 100.0, F.col("images"))
    )
    if runs is None:
        return long
    seconds = (
        runs.filter(F.col("stage").isin(list(flags)))
        .groupBy("stage")
        .agg(F.max("elapsed_s").alias("elapsed_s"))
    )
    return long.join(F.broadcast(seconds), "stage", "left").withColumn(
        "seconds_per_image", measures.per_image_seconds(F.col("elapsed_s"), F.col("images"))
    )


def model_comparison_by_species(combined: DataFrame) -> DataFrame:
    """The three rates per true label, and which of the first two is ahead."""
    rates = {stage: measures.mean_flag(column) for stage, column in STAGE_FLAGS.items()}
    return _rates_by_species(combined, rates, F.count("*"))


def model_comparison_by_species_from(tallied: DataFrame) -> DataFrame:
    """``model_comparison_by_species`` of the rows that were tallied with the stages' flags."""
    rates = {
        stage: F.try_divide(F.sum(column), F.sum(f"{column}_known"))
        for stage, column in STAGE_FLAGS.items()
    }
    return _rates_by_species(tallied, rates, _total("images"))


def _rates_by_species(rows: DataFrame, rates: dict[str, Column], images: Column) -> DataFrame:
    percent = [(rate * 100.0).alias(f"{stage}_pct") for stage, rate in rates.items()]
    ahead = F.col("identification_pct") > F.col("localisation_pct")
    return (
        rows.groupBy("true_species")
        .agg(*percent, images.alias("images"))
        .withColumn("winner", F.when(ahead, "BioCLIP").otherwise("MegaDetector"))
    )


def confidence_by_pipeline(detections: DataFrame) -> DataFrame:
    return (
        detections.groupBy("pipeline")
        .agg((F.avg("confidence") * 100.0).alias("confidence_pct"))
        .withColumn("pipeline_label", text.pipeline_label("pipeline"))
    )


def site_summary(detections: DataFrame) -> DataFrame:
    """Images, correct ones, mean confidence and accuracy per camera and habitat.

    Rows without a camera or habitat belong to no site. Most images first.
    """
    keys = [k for k in ("camera_id", "habitat_type") if k in detections.columns]
    return (
        detections.dropna(subset=keys)
        .groupBy(*keys)
        .agg(
            F.count("image_id").alias("images"),
            F.count_if("correct").alias("correct"),
            F.avg("confidence").alias("mean_confidence"),
        )
        .withColumn("accuracy_pct", F.try_divide(F.col("correct") * 100.0, F.col("images")))
        .orderBy(F.desc("images"), *keys)
    )


def detection_metrics(detections: DataFrame) -> DataFrame:
    """Rows, accuracy, mean confidence and localised rows."""
    return detections.agg(
        F.count("*").alias("images"),
        (measures.mean_flag("correct") * 100.0).alias("accuracy_pct"),
        (F.avg("confidence") * 100.0).alias("confidence_pct"),
        F.count_if("localised").alias("localised"),
    )


def export_summary(detections: DataFrame) -> DataFrame:
    """Rows and accuracy per pipeline."""
    return (
        detections.groupBy("pipeline")
        .agg(
            F.count("*").alias("rows"),
            (measures.mean_flag("correct") * 100.0).alias("accuracy_pct"),
        )
        .withColumn("pipeline_label", text.pipeline_label("pipeline"))
    )


def confidence_histogram(detections: DataFrame, bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """Rows per equal-width bin of [0, 1], split by verdict; 1.0 is in the last bin."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return (
        detections.filter(F.col("confidence").isNotNull())
        .groupBy("correct", at.alias("bin"))
        .agg(F.count("*").alias("images"))
        .withColumn("bin_from", F.col("bin") / F.lit(float(bins)))
    )


QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
QUARTILE_NAMES = ("lowest", "lower_quartile", "median", "upper_quartile", "highest")
# A group's value range is cut into this many slices, and each slice into as many again.
_SLICES = 4096


def quality_box_stats(
    detections: DataFrame,
    column: str = "detection_quality",
    by: str = "pipeline",
    few_values: bool = False,
) -> DataFrame:
    """Exact quartiles of a score per group, linear between neighbours.

    An exact percentile aggregate would hold one group's values in one task.
    Instead equal values collapse to a count where they are. ``few_values`` states that a
    group has a bounded number of different values, as a score of four decimals does
    (10,001); their counts are then put in order as they are. Otherwise the counts are
    stored, so that the detections are read once. Slices between a group's lowest and highest value are
    counted, those that contain a wanted rank are cut once more, and only the narrow
    slices left over are ordered, each on its own.
    """
    counts = (
        detections.filter(F.col(column).isNotNull())
        .groupBy(by, F.col(column).alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    if few_values:
        return _quartiles_of_counts(counts, by)
    counts = stored(counts, "value-counts")
    ends = counts.groupBy(by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    width = F.greatest(F.col("_high") - F.col("_low"), F.lit(2.0**-1000)) / _SLICES
    last = F.lit(_SLICES - 1)
    wide = F.least(F.floor((F.col("_v") - F.col("_low")) / width), last)
    start = F.col("_low") + F.col("_wide") * width
    narrow = F.floor((F.col("_v") - start) / (width / _SLICES))
    values = (
        counts.join(ends, by)
        .withColumn("_wide", wide)
        .withColumn("_narrow", F.greatest(F.least(narrow, last), F.lit(0)))
        .drop("_low", "_high")
    )
    per_wide = values.groupBy(by, "_wide").agg(F.sum("_n").alias("_n"))
    totals = per_wide.groupBy(by).agg(F.sum("_n").alias("n"))
    places = [F.lit(p) * (F.col("n") - 1) for p in QUARTILES]
    ranks = F.array_distinct(
        F.concat(*[F.array(F.floor(at), F.ceil(at)) for at in places])
    )
    wanted = totals.select(by, F.lit(0).cast("bigint").alias("_start"), ranks.alias("_ranks"))

    in_wide = _slices_with_ranks(per_wide, wanted, [by], "_wide")
    per_narrow = (
        values.join(in_wide.select(by, "_wide"), [by, "_wide"], "left_semi")
        .groupBy(by, "_wide", "_narrow")
        .agg(F.sum("_n").alias("_n"))
    )
    in_narrow = _slices_with_ranks(per_narrow, in_wide, [by, "_wide"], "_narrow")
    in_order = Window.partitionBy(by, "_wide", "_narrow").orderBy("_v")
    at_rank = (
        values.join(in_narrow, [by, "_wide", "_narrow"])
        .withColumn("_to", F.col("_start") + F.sum("_n").over(in_order))
        .withColumn("_rank", F.explode("_ranks"))
        .filter((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_n")))
    )
    # At most ten ranks per group.
    entries = F.collect_list(F.struct("_rank", "_v"))
    ranked = at_rank.groupBy(by).agg(F.map_from_entries(entries).alias("_at"))
    columns = []
    for name, at in zip(QUARTILE_NAMES, places):
        low, high = F.col("_at")[F.floor(at)], F.col("_at")[F.ceil(at)]
        columns.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return totals.join(ranked, by).select(by, "n", *columns)


def _quartiles_of_counts(counts: DataFrame, by: str) -> DataFrame:
    """``quality_box_stats`` from counts of few values: those at the wanted ranks, in one pass."""
    group = Window.partitionBy(by)
    upto = F.sum("_n").over(group.orderBy("_v"))
    placed = counts.select(by, "_v", "_n", upto.alias("_to"), F.sum("_n").over(group).alias("n"))
    columns, values = [], []
    for name, p in zip(QUARTILE_NAMES, QUARTILES):
        at = F.lit(p) * (F.col("n") - 1)
        for rank, end in ((F.floor(at), "low"), (F.ceil(at), "high")):
            inside = (rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_n"))
            values.append(F.max(F.when(inside, F.col("_v"))).alias(f"{name}_{end}"))
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        columns.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return placed.groupBy(by, "n").agg(*values).select(by, "n", *columns)


def _slices_with_ranks(
    counts: DataFrame, wanted: DataFrame, keys: list[str], slice_column: str
) -> DataFrame:
    """The slices that hold a wanted rank, with their first rank and those ranks.

    ``counts`` has ``_n`` rows per key and slice, at most ``_SLICES`` slices a key;
    ``wanted`` has the rank each key starts at and the ranks looked for.
    """
    so_far = F.sum("_n").over(Window.partitionBy(*keys).orderBy(slice_column))
    first = F.col("_start") + F.col("_before")
    inside = F.filter("_ranks", lambda r: (r >= first) & (r < first + F.col("_n")))
    return (
        counts.withColumn("_before", so_far - F.col("_n"))
        .join(wanted, keys)
        .withColumn("_found", inside)
        .filter(F.size("_found") > 0)
        .select(*keys, slice_column, first.alias("_start"), F.col("_found").alias("_ranks"))
    )


def validation_summary(checked: DataFrame) -> DataFrame:
    """Files received, accepted, rejected, and accepted without a time."""
    return checked.agg(
        F.count("*").alias("received"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if(F.col("accepted") & (F.col("timestamp") == fixed.NO_TIMESTAMP)).alias(
            "no_timestamp"
        ),
    )
