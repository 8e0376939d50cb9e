"""Top rows, per group or overall, and last-wins lookups."""

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this many rows per group, what the map tasks forward fits one task.
SMALL_N = 20


def top_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """First ``n`` rows of each group under ``order``, exactly.

    ``row_number() <= n`` lets Spark cut each group inside the map task, so a hot
    group costs n rows per map task. For larger n these are merged in rounds: rows
    are ranked by group and slice, a slice being a share of the map tasks, and only
    the winners go on. Above the n up to which Spark cuts in the map task the first
    round takes as many slices as there are shuffle partitions. How rows fall into
    slices does not matter to the result.
    """
    if n > SMALL_N:
        conf = df.sparkSession.conf
        wide = int(conf.get("spark.sql.shuffle.partitions"))
        narrow = max(2, isqrt(wide))
        cut_in_map = n <= int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
        df = df.withColumn("_slice", F.spark_partition_id())
        for slices in [narrow] if cut_in_map else [wide, narrow]:
            df = df.withColumn("_slice", F.col("_slice") % slices)
            df = _cut(df, [*keys, "_slice"], order, n)
        df = df.drop("_slice")
    return _cut(df, keys, order, n)


def _cut(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop(
        "_rank"
    )


def head_per_species(
    images: DataFrame, n: int | None, seq: str = "seq", labels: Sequence[str] | None = None
) -> DataFrame:
    """First ``n`` images of each species in table order; all when ``n`` is None.

    ``labels`` selects species. Each label is cut within the map tasks first.
    """
    if labels is not None:
        images = images.filter(F.col("species_label").isin(list(labels)))
    if not n:
        return images
    return top_n_per_group(images, ["species_label"], [F.col(seq)], n)


def preview(df: DataFrame, n: int, seq: str) -> DataFrame:
    """First ``n`` rows in table order."""
    return df.orderBy(seq).limit(n)


def sort_detections(detections: DataFrame, order: str = "confidence_high") -> DataFrame:
    """Order by confidence or by verdict, with the image id breaking ties."""
    orders = {
        "confidence_high": F.desc("confidence"),
        "confidence_low": F.asc("confidence"),
        "correct_first": F.desc("correct"),
    }
    return detections.orderBy(orders[order], "image_id")


def latest(df: DataFrame, key: str, columns: Sequence[str], seq: str) -> DataFrame:
    """One row per key holding ``columns`` of the row with the highest ``seq``."""
    values = F.struct(*columns)
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(values, seq).alias("_last"))
        .select(key, *[F.col("_last")[c].alias(c) for c in columns])
    )
