"""Continuous validation of arriving image files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spoorline.operators.images import validate_images
from spoorline.sources.tables import path_exists

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def image_file_stream(
    spark: SparkSession, path: str, files_per_batch: int = 1000
) -> DataFrame:
    """New files under ``path`` with their bytes."""
    return (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def ingest_stream(
    files: DataFrame, output: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Validate a stream of files into one table, split by ``accepted``.

    Each file is checked on its own, so the job keeps no state. The file sink
    records finished batches, so a batch repeated after a failure counts once.
    """
    writer = (
        validate_images(files)
        .writeStream.format("parquet")
        .partitionBy("accepted")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


CHECKED = (
    "file string, format string, resolution string, timestamp string, size_kb double, "
    "reason string, accepted boolean"
)


def read_ingested(spark: SparkSession, output: str, accepted: bool | None = None) -> DataFrame:
    """The ingested table, or only its accepted or rejected part."""
    table = spark.read.schema(CHECKED).parquet(output)
    return table if accepted is None else table.filter(table.accepted == accepted)


#: What an accepted and a rejected upload are told by.
ACCEPTED = ("file", "format", "resolution", "timestamp", "size_kb", "digest", "arrived")
REJECTED = ("file", "reason", "digest", "arrived")


def first_uploads(files: DataFrame, within: str, arrived: str | Column | None = None) -> DataFrame:
    """Checked files, each name and content once ``within`` a time such as ``1 day``.

    A file counts as sent again if its name and the SHA-256 of its bytes are those of one
    that arrived no longer than ``within`` before; a later one is a new upload. Arrival
    is the time of the batch unless ``arrived`` says otherwise; then rows that are behind
    the newest by more than ``within`` are too late for the stream and left out. Files are
    checked first, so the state holds names and digests and no bytes move.
    """
    when = F.current_timestamp() if arrived is None else F.col(arrived) if isinstance(arrived, str) else arrived
    marked = files.withColumns({"digest": F.sha2("content", 256), "arrived": when})
    checked = validate_images(marked, keep=("digest", "arrived"))
    return checked.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["file", "digest"])


def ingest_tables(
    files: DataFrame,
    accepted: str,
    rejected: str,
    checkpoint: str,
    within: str = "1 day",
    arrived: str | Column | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Validate a stream of files into a table of accepted and one of rejected uploads.

    Repeated uploads count once, see ``first_uploads``. Every batch owns a folder in each
    table and replaces it whole, so a batch that is run again after a failure, also one
    between the two writes, leaves each row once.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for path, verdict, columns in ((accepted, True, ACCEPTED), (rejected, False, REJECTED)):
                write_batch(rows.filter(F.col("accepted") == verdict).select(*columns), path, number)
        finally:
            rows.unpersist()

    writer = (
        first_uploads(files, within, arrived)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def write_batch(rows: DataFrame, path: str, number: int) -> None:
    """A batch's rows in the folder of its number, in place of what is there."""
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    """Accepted uploads with the batch that brought them."""
    return _batches(spark, path, "file string, format string, resolution string, timestamp string, size_kb double, digest string, arrived timestamp")


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Rejected uploads with the batch that brought them."""
    return _batches(spark, path, "file string, reason string, digest string, arrived timestamp")


def _batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(path)
