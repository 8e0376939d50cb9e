"""From raw detector boxes and masks to one outcome per image.

Boxes have ``image_id``, ``box_id``, ``class_id`` (or ``category``), ``conf`` and
coordinates; masks have ``image_id``, ``mask_id`` and ``conf``. The best of an
image is the smallest (lower is better) key, so that ids of any type break ties
and each image keeps one row however many boxes it has: the aggregates combine
inside the map task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline import fixed_values as fixed
from spoorline.functions.geometry import encode_box, to_pixels

def is_animal_class(class_id: str = "class_id") -> Column:
    return F.col(class_id).between(fixed.ANIMAL_CLASS_FIRST, fixed.ANIMAL_CLASS_LAST)


def _kept(min_conf: float) -> Column:
    """Plain predicate, so that a scan can take it; null counts as not kept."""
    return is_animal_class() & (F.col("conf") >= min_conf)


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _best_first(df: DataFrame, id_column: str, *before: Column) -> Column:
    """Struct whose minimum is the best row: confidence, then id, then the rest."""
    rest = [c for c in df.columns if c not in ("image_id", id_column)]
    head = [c.alias(f"_k{i}") for i, c in enumerate(before)]
    rank = F.coalesce(-F.col("conf"), F.lit(float("inf"))).alias("_rank")
    return F.struct(*head, rank, id_column, *rest)


def _unpack(df: DataFrame, best: str, columns: list[str]) -> DataFrame:
    return df.select(
        *["image_id" if c == "image_id" else F.col(best)[c].alias(c) for c in columns]
    )


def best_box(boxes: DataFrame, id_column: str = "box_id") -> DataFrame:
    """Highest-confidence box of each image, the first one on ties."""
    best = boxes.groupBy("image_id").agg(F.min(_best_first(boxes, id_column)).alias("_best"))
    return _unpack(best, "_best", boxes.columns)


def best_mask(masks: DataFrame) -> DataFrame:
    """Highest-confidence mask of each image, the first one on ties."""
    return best_box(masks, "mask_id")


def animal_boxes(boxes: DataFrame, min_conf: float = fixed.BOX_MIN_CONFIDENCE) -> DataFrame:
    """All confident animal boxes; an image without any keeps its best box.

    The kept boxes are a plain filter and never move. Only one candidate per
    image is shuffled to find the images that need the fallback.
    """
    keep = _known(_kept(min_conf))
    fallback = (
        boxes.groupBy("image_id")
        .agg(
            F.bool_or(keep).alias("_any"),
            F.min(F.when(~keep, _best_first(boxes, "box_id"))).alias("_best"),
        )
        .filter(~F.col("_any"))
    )
    return boxes.filter(_kept(min_conf)).unionByName(_unpack(fallback, "_best", boxes.columns))


def best_animal_box(boxes: DataFrame) -> DataFrame:
    """Best animal box of each image, or its best box of any class."""
    key = _best_first(boxes, "box_id", (~_known(is_animal_class())).cast("int"))
    best = boxes.groupBy("image_id").agg(F.min(key).alias("_best"))
    return _unpack(best, "_best", boxes.columns)


def category_boxes(
    boxes: DataFrame,
    width,
    height,
    min_conf: float = fixed.BOX_MIN_CONFIDENCE,
) -> DataFrame:
    """Confident boxes of the animal category, in pixels, without a fallback."""
    kept = boxes.filter((F.col("category") == fixed.ANIMAL_CATEGORY) & (F.col("conf") >= min_conf))
    corners = to_pixels(F.col("x"), F.col("y"), F.col("w"), F.col("h"), width, height)
    return kept.withColumns(corners).drop("x", "y", "w", "h")


def class_boxes(boxes: DataFrame, min_conf: float = fixed.BOX_MIN_CONFIDENCE) -> DataFrame:
    """Confident boxes of an animal class, without a fallback."""
    return boxes.filter(_kept(min_conf))


def mask_instances(masks: DataFrame) -> DataFrame:
    """All masks; a mask without confidence counts as certain."""
    return masks.withColumn("conf", F.coalesce("conf", F.lit(1.0)))


def single_mask(images: DataFrame, masks: DataFrame) -> DataFrame:
    """One mask per image with count 1, and count 0 where there is none."""
    best = best_mask(masks).select("image_id", "mask_id", "conf")
    return (
        images.select("image_id")
        .join(best, "image_id", "left")
        .withColumn("instance_count", F.col("mask_id").isNotNull().cast("int"))
    )


def instance_counts(images: DataFrame, found: DataFrame) -> DataFrame:
    """Number of boxes or masks per image, 0 included."""
    counts = found.groupBy("image_id").agg(F.count("*").cast("int").alias("instance_count"))
    return (
        images.select("image_id")
        .join(counts, "image_id", "left")
        .withColumn("instance_count", F.coalesce("instance_count", F.lit(0)))
    )


def localise(images: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """Adds location_type, location, detection_quality and instance_count.

    ``found`` holds what the detector kept: boxes with pixel corners for kind
    ``bbox``, masks for kind ``mask``. Best one and count come from a single
    aggregate per image.
    """
    id_column = "box_id" if kind == "bbox" else "mask_id"
    outcome = found.groupBy("image_id").agg(
        F.min(_best_first(found, id_column)).alias("_best"),
        F.count("*").cast("int").alias("_n"),
    )
    return _with_outcome(images, outcome, kind)


def localise_animals(
    images: DataFrame, boxes: DataFrame, min_conf: float = fixed.BOX_MIN_CONFIDENCE
) -> DataFrame:
    """``localise`` over ``animal_boxes`` in one aggregate instead of two."""
    keep = _known(_kept(min_conf))
    key = _best_first(boxes, "box_id")
    outcome = (
        boxes.groupBy("image_id")
        .agg(
            F.min(F.when(keep, key)).alias("_kept"),
            F.min(F.when(~keep, key)).alias("_other"),
            F.count_if(keep).cast("int").alias("_n"),
        )
        .select(
            "image_id",
            F.coalesce("_kept", "_other").alias("_best"),
            F.greatest("_n", F.lit(1)).alias("_n"),
        )
    )
    return _with_outcome(images, outcome, "bbox")


def _with_outcome(images: DataFrame, outcome: DataFrame, kind: str) -> DataFrame:
    missing = F.col("_n").isNull()
    if kind == "bbox":
        place = encode_box("_best.x1", "_best.y1", "_best.x2", "_best.y2")
        nothing = fixed.NO_DETECTION
    else:
        place, nothing = F.lit(fixed.LOCATION_MASK), fixed.NO_MASK
    return (
        images.join(outcome, "image_id", "left")
        .withColumns(
            {
                "location_type": F.lit(kind),
                "location": F.when(missing, nothing).otherwise(place),
                "detection_quality": F.coalesce("_best.conf", F.lit(0.0)),
                "instance_count": F.coalesce("_n", F.lit(0)),
            }
        )
        .drop("_best", "_n")
    )
