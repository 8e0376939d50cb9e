"""Reading metadata, detections, annotations and results."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoorline import fixed_values as fixed
from spoorline import schemas
from spoorline.operators.filters import filter_species, resolve_paths


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(hadoop_path)


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first candidate path that exists."""
    for path in candidates:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError("none of these exists: " + ", ".join(candidates))


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        # a value that does not fit its column fails the job instead of becoming null
        reader = reader.option("header", True).option("escape", '"').option("mode", "FAILFAST")
        return reader.csv(path)
    return reader.format(fmt).load(path)


#: In the folder of a published table, the file that names the version to read.
POINTER = "_CURRENT"


def published(spark: SparkSession, path: str) -> str:
    """The folder that holds the current version of a table, or the path itself."""
    pointer = f"{path.rstrip('/')}/{POINTER}"
    if not path_exists(spark, pointer):
        return path
    place = spark._jvm.org.apache.hadoop.fs.Path(pointer)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        version = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{path.rstrip('/')}/{version.strip()}"


def in_file_order(rows: DataFrame, fmt: str, seq: str = "seq") -> DataFrame:
    """Rows as they are read, with their place in the table: files by path, then rows as in the file.

    Places are 0, 1, 2, ... whatever the size of the splits. Parquet tells a row's number
    in its file; of other formats each split's rows are numbered as they are read. What
    lies before comes from a count of rows a file, or a split, in one more pass without
    columns; that small table is the only thing put in order. A read whose splits do not
    fit the count (the files changed meanwhile) fails.
    """
    file = F.col("_metadata.file_path")
    if fmt == "parquet":
        at, own = F.lit(0).cast("long"), F.col("_metadata.row_index")
    else:
        at, own = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    placed = rows.select("*", file.alias("_file"), at.alias("_at"), own.alias("_row"))
    splits = placed.groupBy("_file", "_at").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = F.col("_row") - F.col("_first")
    place = F.when(inside.between(0, F.col("_n") - 1), F.col("_before") + inside)
    wrong = F.raise_error(F.lit("files changed while they were read")).cast("long")
    numbered = placed.join(splits, ["_file", "_at"], "left")
    return numbered.select(*rows.columns, F.coalesce(place, wrong).alias(seq))


def read_images(
    spark: SparkSession, path: str, fmt: str = "csv", enriched: bool = False, ordered: bool = False
) -> DataFrame:
    """Image metadata with a declared schema; ids stay text. ``ordered`` adds ``seq``, the table order."""
    schema = schemas.ENRICHED_IMAGES if enriched else schemas.IMAGES
    rows = _read(spark, published(spark, path), schema, fmt)
    return in_file_order(rows, fmt) if ordered else rows


def read_species(
    spark: SparkSession,
    path: str,
    species: str,
    files: DataFrame | None = None,
    root: str = "",
    directories: Sequence[str] = (),
    fmt: str = "csv",
    ordered: bool = False,
) -> DataFrame:
    """Images of one label, with paths resolved when a file listing is given."""
    images = filter_species(read_images(spark, path, fmt, ordered=ordered), species)
    return images if files is None else resolve_paths(images, files, root, directories)


def read_detections(
    spark: SparkSession,
    path: str,
    pipeline: str | None = None,
    species: str | None = None,
    image_ids: Sequence[str] = (),
) -> DataFrame:
    """Stored detections. No table gives no rows.

    The first two filters select folders; ``image_ids`` skips row groups without those images.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.DETECTIONS)
    rows = spark.read.schema(schemas.DETECTIONS).parquet(path).select(
        *schemas.DETECTIONS.fieldNames()
    )
    if pipeline is not None:
        rows = rows.filter(F.col("pipeline") == pipeline)
    if species is not None:
        rows = rows.filter(F.col("species") == species)
    if image_ids:
        rows = rows.filter(F.col("image_id").isin(list(image_ids)))
    return rows


def read_all_detections(spark: SparkSession, path: str, species: str) -> DataFrame:
    """Detections of one label by every registered pipeline, in one scan."""
    rows = read_detections(spark, path, species=species)
    return rows.filter(F.col("pipeline").isin(fixed.PIPELINE_ORDER))


def read_detections_csv(spark: SparkSession, path: str) -> DataFrame:
    """Detections exchanged as CSV."""
    return _read(spark, path, schemas.DETECTIONS, "csv")


def read_annotations(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Annotations of JSON documents ``{"annotations": [...]}`` with their order.

    A document is a file, which one task reads, or with ``lines`` a line of a file, which
    splits. Keep a large set as lines, or convert it to Parquet once. A document that
    does not fit the declared shape fails the job. ``pos`` orders the annotations as in
    the files; fields that are not declared, nested ones too, are passed over.
    """
    document = T.StructType([T.StructField("annotations", T.ArrayType(schemas.ANNOTATION))])
    reader = spark.read.schema(document).option("mode", "FAILFAST").option("multiLine", not lines)
    place = F.struct(
        F.col("_file").alias("file"), F.col("_row").alias("row"), F.col("_at").alias("at")
    )
    return (
        reader.json(path)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.monotonically_increasing_id().alias("_row"),
            "annotations",
        )
        .select("_file", "_row", F.posexplode("annotations").alias("_at", "a"))
        .select(place.alias("pos"), "a.*")
    )


def read_evaluation(
    spark: SparkSession, path: str, fmt: str = "parquet", targets: Sequence[str] = ()
) -> DataFrame:
    """Evaluation rows; ``targets`` names the score columns of the wide form."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.EVALUATION)
    scores = [T.StructField(f"score_{t}", T.DoubleType()) for t in targets]
    return _read(spark, path, T.StructType(schemas.EVALUATION.fields + scores), fmt)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Scores in long form."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.SCORES)
    return _read(spark, path, schemas.SCORES, "parquet")


def read_comparison(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Identification and localisation rows of the model comparison."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.MODEL_COMPARISON)
    return _read(spark, path, schemas.MODEL_COMPARISON, fmt)


def read_count_errors(spark: SparkSession, path: str) -> DataFrame:
    """Stored count-error rows."""
    return _read(spark, path, schemas.COUNT_ERRORS, "csv")
