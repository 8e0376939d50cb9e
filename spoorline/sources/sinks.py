"""Writing detections, evaluations, enriched metadata and reports."""

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from spoorline import schemas
from spoorline.sources.tables import POINTER, published


def write_detections(detections: DataFrame, path: str) -> None:
    """Store detections by pipeline and species, replacing only what they cover.

    The rebalance hint lets adaptive execution gather small folders into few
    files and split a large one over many tasks. No rows write nothing. Within a file
    rows are in the order of ``image_id``, which also has a Bloom filter, so that
    reading a few images skips the row groups without them.
    """
    rows = detections.select(*schemas.DETECTIONS.fieldNames())
    spread = rows.hint("rebalance", "pipeline", "species")
    (
        _with_blooms(spread.sortWithinPartitions("pipeline", "species", "image_id"), ["image_id"])
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("pipeline", "species")
        .parquet(path)
    )


def _with_blooms(rows: DataFrame, columns: Sequence[str]) -> DataFrameWriter:
    """A writer of Parquet with a Bloom filter, as large as the row group needs, on each column."""
    writer = rows.write.option("parquet.bloom.filter.adaptive.enabled", True)
    for column in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True)
    return writer


def write_clustered(
    rows: DataFrame, path: str, by: Sequence[str] = ("species_label", "image_id"), lookup: Sequence[str] = ("image_id",)
) -> None:
    """Store rows as Parquet in ranges of ``by``, with Bloom filters on ``lookup``.

    Reading one label, or one image, then skips the row groups without it. The last of
    ``by`` should tell rows apart, so that a label with most rows is cut into many ranges.
    The order of the rows is not kept: store ``seq`` where it is needed.
    """
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    _with_blooms(ranges, lookup).mode("overwrite").parquet(path)


def write_bucketed(
    rows: DataFrame, table: str, path: str, buckets: int, key: str = "image_id"
) -> DataFrame:
    """Store rows as a table in buckets by image and read it back.

    Joins and aggregates by ``key`` over tables of one bucket count then shuffle none of
    them. A task joins a whole bucket: of a table in which one image holds a large part
    of the rows, keep the images' last rows only, or leave it without buckets, where
    adaptive execution splits such an image.
    """
    (
        rows.repartition(buckets, key)
        .write.mode("overwrite")
        .bucketBy(buckets, key)
        .sortBy(key)
        .format("parquet")
        .option("path", path)
        .saveAsTable(table)
    )
    return rows.sparkSession.table(table)


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_merged(merged: DataFrame, path: str) -> None:
    """Store the union of the pipelines' detections as CSV."""
    _csv(merged, path)


def write_evaluation(evaluation: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store evaluation rows, long or wide."""
    if fmt == "csv":
        _csv(evaluation, path)
    else:
        evaluation.write.mode("overwrite").format(fmt).save(path)


def write_model_comparison(combined: DataFrame, path: str, fmt: str = "parquet") -> None:
    rows = combined.select(*schemas.MODEL_COMPARISON.fieldNames())
    if fmt == "csv":
        _csv(rows, path)
    else:
        rows.write.mode("overwrite").format(fmt).save(path)


def write_count_errors(errors: DataFrame, path: str) -> None:
    """Store the nine columns of the count evaluation."""
    _csv(errors.select(*schemas.COUNT_ERRORS.fieldNames()), path)


def export_csv(detections: DataFrame, path: str) -> None:
    """Export one pipeline's detections, or any selection of them."""
    _csv(detections, path)


def write_enriched_images(enriched: DataFrame, path: str, fmt: str = "csv") -> None:
    """Publish a new version of image metadata that the frame may itself be read from.

    Each version is a folder of its own under ``path``; when it is complete, the file
    that names the current one is replaced. Nothing is renamed or copied, readers see
    the old or the new version, and older ones stay until ``drop_versions``.
    """
    spark = enriched.sparkSession
    version = f"version-{time.time_ns():020d}-{uuid.uuid4().hex}"
    fresh = f"{path.rstrip('/')}/{version}"
    if fmt == "csv":
        _csv(enriched, fresh)
    else:
        enriched.write.format(fmt).save(fresh)
    pointer, system = _file(spark, f"{path.rstrip('/')}/{POINTER}")
    out = system.create(pointer, True)
    out.write(bytearray(version.encode()))
    out.close()


def drop_versions(spark: SparkSession, path: str) -> None:
    """Delete the versions of a published table that are no longer the current one."""
    current = published(spark, path).rsplit("/", 1)[-1]
    folder, system = _file(spark, path)
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version-") and name != current:
            system.delete(status.getPath(), True)


def _file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def write_report(lines: DataFrame, path: str) -> None:
    """Store a report page as one text file. A page has tens of lines."""
    (
        lines.repartition(1)
        .sortWithinPartitions("section", "rank", "name")
        .select("text")
        .write.mode("overwrite")
        .text(path)
    )
