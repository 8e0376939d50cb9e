"""Queries on paths, file tables and uploads."""

from pyspark.sql import functions as F

from spoorline import schemas
from spoorline.driver.registry import query, round4
from spoorline.driver.retrieval import SCORES, TOP1, top1
from spoorline.driver.truth import ERRORS, errors
from spoorline.driver.views import table, view
from spoorline.operators import aggregates, filters, similarity
from spoorline.operators.images import validate_images as validate
from spoorline.session import scratch_dir
from spoorline.sources import files, sinks, tables
from spoorline.streaming import ingest

# Where the file of an image lies: at its own path, in one of two searched
# folders (or in both), or in a folder that is not searched.
LISTING = """
listing AS (
  SELECT CASE seq % 4 WHEN 0 THEN concat('/study/', local_image_path)
                      WHEN 1 THEN concat('/archive/one/', image_id, '.jpg')
                      WHEN 2 THEN concat('/archive/two/', image_id, '.jpg')
                      ELSE concat('/elsewhere/', image_id, '.jpg') END AS path
  FROM v_images
  UNION ALL
  SELECT concat('/archive/two/', image_id, '.jpg') FROM v_images WHERE species_label = 'click')
"""
RESOLVED = f"""
{LISTING},
resolved AS (
  SELECT i.image_id, coalesce(e.path, one.path, two.path, i.local_image_path)
           AS local_image_path
  FROM v_images i
  LEFT JOIN (SELECT DISTINCT path FROM listing) e
    ON e.path = concat('/study/', i.local_image_path)
  LEFT JOIN (SELECT DISTINCT path FROM listing) one
    ON one.path = concat('/archive/one/', i.image_id, '.jpg')
  LEFT JOIN (SELECT DISTINCT path FROM listing) two
    ON two.path = concat('/archive/two/', i.image_id, '.jpg'))
"""


def listing(spark, sf_dir):
    images = view(spark, sf_dir, "v_images")
    name = F.concat("image_id", F.lit(".jpg"))
    kind = F.col("seq") % 4
    own = (
        F.when(kind == 0, F.concat(F.lit("/study/"), "local_image_path"))
        .when(kind == 1, F.concat(F.lit("/archive/one/"), name))
        .when(kind == 2, F.concat(F.lit("/archive/two/"), name))
        .otherwise(F.concat(F.lit("/elsewhere/"), name))
    )
    second = images.filter("species_label = 'click'").select(
        F.concat(F.lit("/archive/two/"), name).alias("path")
    )
    return images.select(own.alias("path")).unionAll(second)


def resolved(spark, sf_dir):
    images = view(spark, sf_dir, "v_images").select("image_id", "local_image_path")
    return filters.resolve_paths(
        images, listing(spark, sf_dir), "/study", ["/archive/one", "/archive/two"]
    )


@query(f"WITH {RESOLVED} SELECT * FROM resolved")
def resolve_paths(spark, sf_dir):
    return resolved(spark, sf_dir)


@query(f"""WITH {RESOLVED}
SELECT * FROM resolved WHERE local_image_path IN (SELECT path FROM listing)""")
def keep_existing(spark, sf_dir):
    return filters.keep_existing(resolved(spark, sf_dir), listing(spark, sf_dir))


@query(f"""WITH {RESOLVED}
SELECT count(*) AS images,
  count(*) FILTER (local_image_path IN (SELECT path FROM listing)) AS found,
  count(*) FILTER (local_image_path NOT IN (SELECT path FROM listing)) AS missing
FROM resolved""")
def existing_counts(spark, sf_dir):
    return filters.existing_counts(resolved(spark, sf_dir), listing(spark, sf_dir))


@query("""SELECT DISTINCT o.overlay_path AS path FROM v_detections o
WHERE o.pipeline = 'bioclip_sam' AND o.image_id IN (
  SELECT image_id FROM v_detections WHERE pipeline = 'bioclip_sam' AND species = 'click')""")
def overlays_for_species(spark, sf_dir):
    rows = view(spark, sf_dir, "v_detections").filter("pipeline = 'bioclip_sam'")
    overlays = rows.select(F.col("overlay_path").alias("path"))
    return filters.overlays_for_species(overlays, rows.filter("species = 'click'"))


_IMAGES = (
    "image_id, local_image_path, species_label, date_captured, site_id, latitude, longitude, "
    "habitat_type"
)


@query(f"SELECT {_IMAGES} FROM v_images")
def images_csv_roundtrip(spark, sf_dir):
    """Written as CSV and read back with the declared schema."""
    path = scratch_dir(spark, "images")
    columns = _IMAGES.split(", ")
    sinks.write_enriched_images(view(spark, sf_dir, "v_images").select(*columns), path)
    return tables.read_images(spark, path)


@query(f"SELECT {_IMAGES} FROM v_images")
def first_existing(spark, sf_dir):
    """The metadata read from the first of several places that is there."""
    path = scratch_dir(spark, "images")
    view(spark, sf_dir, "v_images").select(*_IMAGES.split(", ")).write.parquet(path)
    found = tables.first_existing(spark, [f"{path}-elsewhere", path, sf_dir])
    return tables.read_images(spark, found, "parquet")


@query("SELECT DISTINCT species_label AS folder, 'parquet' AS kind FROM v_images")
def list_files(spark, sf_dir):
    """The files of a stored table by folder; the listing does not read them."""
    path = scratch_dir(spark, "images")
    view(spark, sf_dir, "v_images").write.partitionBy("species_label").parquet(path)
    listed = files.list_files(spark, path, "*.parquet").filter("length > 0")
    folder = F.regexp_extract("path", "species_label=([^/]*)/[^/]*$", 1).alias("folder")
    return listed.select(folder, F.regexp_extract("path", "[.]([a-z]+)$", 1).alias("kind")).distinct()


def _overlay_files(spark, sf_dir):
    """A folder with an overlay file for each image, by pipeline and site; the text names the image."""
    folder = scratch_dir(spark, "overlays")
    rows = view(spark, sf_dir, "v_detections").select("pipeline", "camera_id", "image_id")

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")
        for batch in batches:
            for pipeline, camera, image in zip(*(c.to_pylist() for c in batch.columns)):
                place = f"{root}/{pipeline}/{camera}"
                system.create_dir(place)
                with system.open_output_stream(f"{place}/{image}_overlay.jpg") as out:
                    out.write(image.encode())
            yield batch.slice(0, 0)

    rows.mapInArrow(write, rows.schema).foreach(lambda row: None)
    return folder


_OVERLAY_FILES = """overlays AS (
  SELECT concat(pipeline, '/', camera_id, '/', image_id, '_overlay.jpg') AS name, pipeline, camera_id, image_id
  FROM v_detections)
"""


@query(f"WITH {_OVERLAY_FILES} SELECT name, length(image_id) AS length FROM overlays")
def list_tree(spark, sf_dir):
    """Every file of a tree, listed by the executors."""
    folder = _overlay_files(spark, sf_dir)
    listed = files.list_tree(spark, folder, "*_overlay.jpg")
    return listed.select(F.regexp_extract("path", "([^/]*/[^/]*/[^/]*)$", 1).alias("name"), "length")


@query(f"""WITH {_OVERLAY_FILES}
SELECT name FROM overlays WHERE pipeline = 'bioclip_sam' ORDER BY name LIMIT 25""")
def list_overlays(spark, sf_dir):
    """The first overlays of a pipeline by name."""
    folder = _overlay_files(spark, sf_dir)
    first = files.list_overlays(spark, f"{folder}/bioclip_sam", 25, by_tasks=True)
    return first.select(F.regexp_extract("path", "([^/]*/[^/]*/[^/]*)$", 1).alias("name"))


@query(f"""WITH {_OVERLAY_FILES}
SELECT pipeline, count(*) AS overlays, sum(length(image_id)) AS bytes FROM overlays GROUP BY pipeline""")
def read_inventory(spark, sf_dir):
    """A listing kept as a table and read in its place."""
    path = scratch_dir(spark, "inventory")
    files.write_inventory(files.list_tree(spark, _overlay_files(spark, sf_dir)), path)
    pipeline = F.regexp_extract("path", "([^/]*)/[^/]*/[^/]*$", 1).alias("pipeline")
    kept = files.read_inventory(spark, path).groupBy(pipeline)
    return kept.agg(F.count("*").alias("overlays"), F.sum("length").alias("bytes"))


@query(f"WITH {_OVERLAY_FILES} SELECT image_id, length(image_id) AS length FROM overlays WHERE pipeline = 'bioclip_yolo'")
def read_image_files(spark, sf_dir):
    """Files with their bytes."""
    found = files.read_image_files(spark, f"{_overlay_files(spark, sf_dir)}/bioclip_yolo", "*_overlay.jpg")
    return found.select(F.col("content").cast("string").alias("image_id"), "length")


@query(f"SELECT {_IMAGES} FROM v_images WHERE species_label = 'view'")
def images_of_species(spark, sf_dir):
    """One label out of a stored Parquet table; the filter reaches the scan."""
    path = scratch_dir(spark, "images")
    columns = _IMAGES.split(", ")
    images = view(spark, sf_dir, "v_images").select(*columns)
    sinks.write_enriched_images(images, path, "parquet")
    return tables.read_species(spark, path, "view", fmt="parquet")


_DETECTIONS = """SELECT substr(sha256(concat_ws('|', pipeline, species, image_id)), 1, 16)
    AS detection_id, image_id, pipeline, timestamp, camera_id, CAST(0 AS DOUBLE) AS latitude,
  CAST(0 AS DOUBLE) AS longitude, '' AS habitat_type, species, confidence, location_type,
  location, detection_quality, instance_count, image_path, '' AS mask_path, overlay_path,
  ground_truth_species,
  CASE WHEN species = ground_truth_species THEN 'correct' ELSE 'incorrect' END AS correct
FROM v_detections"""


def _stored_detections(spark, sf_dir):
    from spoorline.functions.measures import correct_label
    from spoorline.functions.text import detection_id

    rows = filters.with_defaults(
        view(spark, sf_dir, "v_detections"),
        {"latitude": 0.0, "longitude": 0.0, "habitat_type": "", "mask_path": ""},
    ).withColumns(
        {
            "detection_id": detection_id("pipeline", "species", "image_id"),
            "correct": correct_label("ground_truth_species", "species"),
        }
    )
    return rows.select(*schemas.DETECTIONS.fieldNames())


@query(f"{_DETECTIONS} WHERE species = 'error'")
def detections_roundtrip(spark, sf_dir):
    """Stored by pipeline and species; reading one species lists its folders only."""
    path = scratch_dir(spark, "detections")
    sinks.write_detections(_stored_detections(spark, sf_dir), path)
    return tables.read_all_detections(spark, path, "error")


@query(f"{_DETECTIONS} WHERE image_id IN ('7', '77', '777')")
def detections_of_images(spark, sf_dir):
    """The stored detections of a few images, by skipping the rest."""
    path = scratch_dir(spark, "detections")
    sinks.write_detections(_stored_detections(spark, sf_dir), path)
    return tables.read_detections(spark, path, image_ids=["7", "77", "777"])


@query(f"SELECT {_IMAGES} FROM v_images WHERE species_label = 'error'")
def images_clustered(spark, sf_dir):
    """One label out of metadata stored in ranges of label and image."""
    path = scratch_dir(spark, "images")
    sinks.write_clustered(view(spark, sf_dir, "v_images").select(*_IMAGES.split(", ")), path)
    return tables.read_species(spark, path, "error", fmt="parquet")


@query(_DETECTIONS)
def detections_csv_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "merged")
    rows = _stored_detections(spark, sf_dir)
    sinks.write_merged(rows, path)
    out = tables.read_detections_csv(spark, path)
    # CSV has one text for both null and the empty string.
    return out.fillna("", subset=["habitat_type", "mask_path"])


def nested_users():
    """An entry of another array that looks like an annotation."""
    return F.struct(F.lit("not an annotation").alias("image_id"), F.lit("9").alias("count"))


@query(f"{_DETECTIONS} WHERE pipeline = 'bioclip_sam'")
def export_csv(spark, sf_dir):
    """One pipeline's detections exported and read back."""
    path = scratch_dir(spark, "export")
    sinks.export_csv(_stored_detections(spark, sf_dir).filter("pipeline = 'bioclip_sam'"), path)
    out = tables.read_detections_csv(spark, path)
    return out.fillna("", subset=["habitat_type", "mask_path"])


@query("SELECT image_id, count, standing FROM v_annotations")
def annotations_json_roundtrip(spark, sf_dir):
    """Documents of up to 1,000 annotations a line, with fields that are not read."""
    path = scratch_dir(spark, "annotations")
    nested = F.struct(F.col("seq").alias("image_id"), F.lit("}").alias("note"))
    rows = view(spark, sf_dir, "v_annotations").select(
        F.floor(F.col("seq") / 1000).alias("part"),
        F.struct("image_id", "count", "standing", nested.alias("extra")).alias("a"),
    )
    documents = rows.groupBy("part").agg(F.collect_list("a").alias("annotations"))
    documents.select("annotations", F.array(nested_users()).alias("users")).write.json(path)
    return tables.read_annotations(spark, path, lines=True).select("image_id", "count", "standing")


@query(f"""WITH {TOP1}
SELECT image_id, true_species, predicted_species, correct, top1_score, true_species_score
FROM top1""")
def evaluation_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "evaluation")
    sinks.write_evaluation(top1(spark, sf_dir), path)
    return tables.read_evaluation(spark, path).select(
        "image_id",
        "true_species",
        "predicted_species",
        "correct",
        "top1_score",
        "true_species_score",
    )


@query(f"WITH {SCORES} SELECT image_id, species, round(1e-9 + score, 4) AS score FROM scores")
def scores_roundtrip(spark, sf_dir):
    """Scores stored in long form, which needs no column per label."""
    path = scratch_dir(spark, "scores")
    scores = similarity.score_all(
        view(spark, sf_dir, "v_gallery"), view(spark, sf_dir, "v_prompts")
    )
    sinks.write_evaluation(scores.select("image_id", "species", "score"), path)
    return tables.read_scores(spark, path).withColumn("score", round4("score"))


@query(f"""WITH {ERRORS}
SELECT image_id, pipeline, instance_count, gt_count, ground_truth_count, count_error,
       exact_match FROM errors""")
def count_errors_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "counts")
    rows = filters.with_defaults(
        errors(spark, sf_dir), {"confidence": 0.0, "detection_quality": 0.0}
    )
    sinks.write_count_errors(rows, path)
    return tables.read_count_errors(spark, path).drop("confidence", "detection_quality")


def _hex(value, digits):
    return F.lpad(F.hex(value), digits, "0")


def uploads(rows):
    """Adds bytes to upload rows: a real file header per kind."""
    width, height = _hex(F.col("width"), 8), _hex(F.col("height"), 8)
    png = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"), width, height, F.lit("080200000000000000")
    )
    frame = F.concat(
        F.lit("FFC0001108"),
        _hex(F.col("height"), 4),
        _hex(F.col("width"), 4),
        F.lit("03012200021101031101FFD9"),
    )
    moment = F.hex(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    exif = F.concat(
        F.lit("FFE10036457869660000" + "49492A0008000000" + "0100" + "3201020014000000"),
        F.lit("1A00000000000000"),
        moment,
        F.lit("00"),
    )
    gif = F.lit("474946383961800280010000003B")
    text = (
        F.when(F.col("kind") == "click", png)
        .when(F.col("kind") == "view", F.concat(F.lit("FFD8"), exif, frame))
        .when(F.col("kind") == "purchase", F.concat(F.lit("FFD8"), frame))
        .when(F.col("kind") == "signup", gif)
        .otherwise("6E6F7420616E20696D616765")
    )
    content = F.unhex(text)
    return rows.select(
        "path", content.alias("content"), F.length(content).cast("bigint").alias("length")
    )


CHECKED = """
checked AS (
  SELECT replace(path, 'upload/', '') AS file, *,
         CASE WHEN kind = 'signup' THEN 'Unsupported format: GIF'
              WHEN kind NOT IN ('click', 'view', 'purchase')
              THEN 'Unreadable file: cannot identify image file'
              WHEN width < 640 OR height < 480
              THEN concat('Resolution ', width, '×', height, ' below minimum') END AS reason,
         CASE kind WHEN 'click' THEN 33 WHEN 'view' THEN 79 ELSE 23 END AS bytes
  FROM v_uploads),
validated AS (
  SELECT file, reason IS NULL AS accepted,
         CASE WHEN reason IS NULL THEN CASE kind WHEN 'click' THEN 'PNG' ELSE 'JPEG' END
         END AS format,
         CASE WHEN reason IS NULL THEN concat(width, '×', height) END AS resolution,
         CASE WHEN reason IS NULL THEN
           CASE kind WHEN 'view' THEN strftime(ts, '%Y:%m:%d %H:%M:%S')
                     ELSE 'not in EXIF' END END AS timestamp,
         CASE WHEN reason IS NULL THEN round(bytes / 1024, 1) END AS size_kb, reason
  FROM checked)
"""


@query(f"WITH {CHECKED} SELECT * FROM validated")
def validate_images(spark, sf_dir):
    return validate(uploads(view(spark, sf_dir, "v_uploads")))


@query(f"""WITH {CHECKED}
SELECT count(*) AS received, count(*) FILTER (accepted) AS accepted,
       count(*) FILTER (NOT accepted) AS rejected,
       count(*) FILTER (accepted AND timestamp = 'not in EXIF') AS no_timestamp
FROM validated""")
def validation_summary(spark, sf_dir):
    return aggregates.validation_summary(validate(uploads(view(spark, sf_dir, "v_uploads"))))


@query(f"WITH {CHECKED} SELECT * FROM validated")
def ingest_stream(spark, sf_dir):
    """The event table read as a stream of files, validated and stored."""
    output = scratch_dir(spark, "ingest")
    run = ingest.ingest_stream(_arriving(spark, sf_dir), f"{output}/table", f"{output}/checkpoint")
    run.awaitTermination()
    return ingest.read_ingested(spark, f"{output}/table")


def _arriving(spark, sf_dir, times=1):
    """The event table as a stream of uploads, each sent so many times."""
    schema = table(spark, sf_dir, "events").schema
    # A pattern, because a file stream takes folders and patterns only.
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    suffix = (
        F.when(F.col("event_type") == "click", ".png")
        .when(F.col("event_type") == "signup", ".gif")
        .otherwise(".jpg")
    )
    rows = source.select(
        F.concat(F.lit("upload/"), F.col("event_id").cast("string"), suffix).alias("path"),
        F.col("event_type").alias("kind"),
        (600 + F.col("event_id") % 97).alias("width"),
        (440 + F.col("user_id") % 89).alias("height"),
        "ts",
    )
    if times > 1:
        rows = rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("again")
    return uploads(rows)


@query(f"""WITH {CHECKED}
SELECT accepted, file, format, resolution, timestamp, size_kb, reason FROM validated""")
def ingest_tables(spark, sf_dir):
    """Every upload sent twice; accepted and rejected ones in tables of their own."""
    output = scratch_dir(spark, "ingest")
    accepted, rejected = f"{output}/accepted", f"{output}/rejected"
    files = _arriving(spark, sf_dir, times=2)
    ingest.ingest_tables(files, accepted, rejected, f"{output}/checkpoint").awaitTermination()
    taken = ingest.read_accepted(spark, accepted).withColumn("accepted", F.lit(True))
    refused = ingest.read_rejected(spark, rejected).withColumn("accepted", F.lit(False))
    both = taken.unionByName(refused, allowMissingColumns=True)
    return both.select("accepted", "file", "format", "resolution", "timestamp", "size_kb", "reason")
