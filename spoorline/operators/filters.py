"""Selections and projections over images, detections and file listings."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline import fixed_values as fixed
from spoorline.functions import geometry, measures, text


def filter_species(images: DataFrame, species: str) -> DataFrame:
    return images.filter(F.col("species_label") == species)


def species_dim(spark: SparkSession, species: Sequence[str] = fixed.TARGET_SPECIES) -> DataFrame:
    """Ordered label dimension with display names and prompts."""
    rows = [(i, s) for i, s in enumerate(species)]
    dim = spark.createDataFrame(rows, "ord int, species string")
    return dim.select(
        "ord",
        "species",
        text.pretty_species("species").alias("display_name"),
        text.concept_prompt("species").alias("concept_prompt"),
        text.species_colour("species").alias("colour"),
    )


def pipeline_dim(spark: SparkSession) -> DataFrame:
    """Registered pipelines in report order with their shown names."""
    rows = [
        (i, p, fixed.PIPELINE_DISPLAY[p]["label"], fixed.PIPELINE_DISPLAY[p]["output"])
        for i, p in enumerate(fixed.PIPELINE_ORDER)
    ]
    return spark.createDataFrame(
        rows, "ord int, pipeline string, pipeline_label string, pipeline_output string"
    )


def target_species(
    images: DataFrame, requested: Sequence[str] | None = None
) -> DataFrame:
    """Requested labels that occur in the images, as species and ord."""
    wanted = species_dim(images.sparkSession, requested or fixed.TARGET_SPECIES)
    present = (
        images.filter(F.col("species_label").isin(list(requested or fixed.TARGET_SPECIES)))
        .select(F.col("species_label").alias("species"))
        .distinct()
    )
    return wanted.join(present, "species", "left_semi").select("species", "ord").orderBy("ord")


def resolve_paths(
    images: DataFrame, files: DataFrame, root: str, directories: Sequence[str]
) -> DataFrame:
    """Rewrites ``local_image_path`` to a file that exists.

    The path as given, or under ``root`` when relative, comes first. Then the
    bare name is looked up in each of ``directories``, in order. A path found
    nowhere stays as it was. ``files`` is a listing with a ``path`` column.
    """
    raw = F.col("local_image_path")
    exact_key = F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit(f"{root}/"), raw))
    exact = files.select(F.col("path").alias("_exact")).distinct()

    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    searched = F.array(*[F.lit(d) for d in directories]).cast("array<string>")
    rank = F.array_position(searched, folder)
    by_name = (
        files.filter(folder.isin(list(directories)))
        .groupBy(text.file_name("path").alias("_name"))
        .agg(F.min_by("path", rank).alias("_by_name"))
    )
    return (
        images.withColumn("_key", exact_key)
        .withColumn("_wanted", text.file_name("local_image_path"))
        .join(exact, F.col("_key") == F.col("_exact"), "left")
        .join(by_name, F.col("_wanted") == F.col("_name"), "left")
        .withColumn("local_image_path", F.coalesce("_exact", "_by_name", raw))
        .drop("_key", "_wanted", "_exact", "_name", "_by_name")
    )


def keep_existing(
    images: DataFrame, files: DataFrame, path: str = "local_image_path"
) -> DataFrame:
    """Images whose file is in the listing."""
    known = files.select(F.col("path").alias(path))
    return images.join(known, path, "left_semi").select(*images.columns)


def existing_counts(images: DataFrame, files: DataFrame) -> DataFrame:
    """How many images were given, found and missing."""
    known = files.select(F.col("path").alias("local_image_path")).distinct()
    marked = images.select("local_image_path").join(
        known.withColumn("_found", F.lit(True)), "local_image_path", "left"
    )
    found = F.count_if(F.col("_found").isNotNull())
    return marked.agg(
        F.count("*").alias("images"),
        found.alias("found"),
        (F.count("*") - found).alias("missing"),
    )


def above_confidence(detections: DataFrame, threshold: float) -> DataFrame:
    return detections.filter(F.col("confidence") >= threshold)


def confidence_caption(detections: DataFrame, threshold: float) -> DataFrame:
    """Rows shown and rows in all, for a threshold."""
    return detections.agg(
        F.count_if(F.col("confidence") >= threshold).alias("shown"),
        F.count("*").alias("total"),
    )


def by_verdict(detections: DataFrame, want_correct: bool) -> DataFrame:
    """Only correct or only incorrect detections, most confident first."""
    return detections.filter(F.col("correct") == F.lit(want_correct)).orderBy(
        F.desc("confidence"), "image_id"
    )


def geolocated(detections: DataFrame) -> DataFrame:
    """Detections with coordinates; (0, 0) means there are none."""
    return detections.dropna(subset=["latitude", "longitude"]).filter(
        (F.col("latitude") != 0) | (F.col("longitude") != 0)
    )


def localised(detections: DataFrame) -> DataFrame:
    """Adds the boolean ``localised``."""
    present = "location" in detections.columns
    return detections.withColumn(
        "localised", measures.is_localised("location") if present else F.lit(False)
    )


def overlays_for_species(overlays: DataFrame, detections: DataFrame) -> DataFrame:
    """Overlays whose image is among the detections; all of them if none is.

    ``overlays`` has a ``path``. Whether anything matched is one EXISTS subquery.
    """
    stems = (
        detections.filter(F.col("image_path").isNotNull())
        .select(text.file_stem("image_path").alias("_stem"))
        .distinct()
    )
    overlay_stem = F.replace(text.file_stem("path"), F.lit("_overlay"), F.lit(""))
    marked = overlays.withColumn("_stem", overlay_stem).join(
        stems.withColumn("_hit", F.lit(True)), "_stem", "left"
    )
    matched = marked.filter(F.col("_hit").isNotNull())
    return (
        marked.filter(F.col("_hit").isNotNull() | ~matched.exists())
        .drop("_stem", "_hit")
        .orderBy("path")
    )


def project_available(
    df: DataFrame, columns: Sequence[str] = tuple(fixed.DETECTION_TABLE_COLUMNS)
) -> DataFrame:
    """The named columns that exist, with confidence as percent text."""
    present = [c for c in columns if c in df.columns]
    return df.select(
        *[text.pct(c).alias(c) if c == "confidence" else F.col(c) for c in present]
    )


def rename_gt(images: DataFrame) -> DataFrame:
    """Ground-truth count columns under the names the count evaluation uses."""
    return images.withColumnsRenamed({"ground_truth_count_num": "gt_count"}).select(
        "image_id", "gt_count", "ground_truth_count"
    )


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Adds absent columns with a default; existing columns keep their nulls."""
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def has_columns(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether all the columns are there; looks at the schema only."""
    return set(columns) <= set(df.columns)


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself, or an error naming the columns that are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def to_detection_records(
    located: DataFrame, pipeline: str, species: str | Column, results_root: str = "results"
) -> DataFrame:
    """The 19 detection columns from images with an outcome and a verdict.

    ``located`` carries the image columns, ``confidence``, the columns added by
    ``localise``, and ground_truth_species and correct.
    """
    rows = with_defaults(
        located,
        {
            "confidence": 1.0,
            "date_captured": "",
            "site_id": "",
            "latitude": 0.0,
            "longitude": 0.0,
            "habitat_type": "",
        },
    )
    if "image_id" not in rows.columns:
        rows = rows.withColumn("image_id", text.file_stem("local_image_path"))
    species = F.lit(species) if isinstance(species, str) else species
    stem = text.file_stem("local_image_path")
    base = f"{results_root}/{pipeline}"
    mask = F.when(
        F.col("location") == fixed.LOCATION_MASK,
        F.concat(F.lit(f"{base}/masks/"), stem, F.lit("_mask.png")),
    ).otherwise("")
    overlay = F.concat(F.lit(f"{base}/overlays/"), stem, F.lit("_overlay.jpg"))
    return rows.select(
        text.detection_id(F.lit(pipeline), species, F.col("image_id")).alias("detection_id"),
        "image_id",
        F.lit(pipeline).alias("pipeline"),
        F.col("date_captured").cast("string").alias("timestamp"),
        F.col("site_id").cast("string").alias("camera_id"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        F.col("habitat_type").cast("string").alias("habitat_type"),
        species.alias("species"),
        text.round4("confidence").alias("confidence"),
        "location_type",
        "location",
        text.round4("detection_quality").alias("detection_quality"),
        "instance_count",
        F.col("local_image_path").alias("image_path"),
        mask.alias("mask_path"),
        overlay.alias("overlay_path"),
        "ground_truth_species",
        "correct",
    )


def map_points(detections: DataFrame) -> DataFrame:
    """Map markers: place, colour, tooltip and popup text per detection."""
    rows = with_defaults(
        geolocated(detections), {"camera_id": "?", "habitat_type": "?", "correct": False}
    )
    good = F.coalesce("correct", F.lit(False))
    verdict = F.when(good, "Correct").otherwise("Incorrect")
    return rows.select(
        "image_id",
        "pipeline",
        "latitude",
        "longitude",
        F.when(good, fixed.COLOUR_CORRECT).otherwise(fixed.COLOUR_INCORRECT).alias("colour"),
        F.concat(F.col("camera_id"), F.lit(" · "), text.pct("confidence", 0)).alias("tooltip"),
        F.concat_ws(
            "\n",
            text.pretty_species("species"),
            F.concat(F.lit("Site: "), F.col("camera_id")),
            F.concat(F.lit("Habitat: "), F.col("habitat_type")),
            F.concat(F.lit("Confidence: "), text.pct("confidence")),
            verdict,
        ).alias("popup"),
    )


def decoded_boxes(detections: DataFrame) -> DataFrame:
    """Adds integer corners read back from the location text."""
    box = geometry.decode_box("location")
    return detections.withColumn("_box", box).select(
        *detections.columns, *[F.col("_box")[c].alias(c) for c in geometry.CORNERS]
    )
