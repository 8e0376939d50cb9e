"""Queries that run whole jobs."""

import uuid

from pyspark.sql import functions as F

from spoorline.driver.detection import LOCALISED_BOXES, boxes
from spoorline.driver.registry import fixed_lines, query, round4
from spoorline.driver.retrieval import OWN, TOP1
from spoorline.driver.truth import _COUNT_ACCURACY, ENRICHED, ERRORS, rounded_accuracy
from spoorline.driver.views import view
from spoorline.operators import joins
from spoorline.plans import jobs
from spoorline.session import scratch_dir, stored
from spoorline.sources import files, sinks, tables


def _gallery(spark, sf_dir):
    return view(spark, sf_dir, "v_gallery")


_RECORD = """substr(sha256(concat_ws('|', 'bioclip_yolo', o.species_label, o.image_id)), 1, 16)
           AS detection_id,
         o.image_id, 'bioclip_yolo' AS pipeline, g.date_captured AS timestamp,
         g.site_id AS camera_id, g.latitude, g.longitude, g.habitat_type,
         o.species_label AS species,
         round(1e-9 + CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1 END, 4)
           AS confidence,
         'bbox' AS location_type, l.location,
         round(1e-9 + l.detection_quality, 4) AS detection_quality, l.instance_count,
         g.local_image_path AS image_path, '' AS mask_path,
         concat('results/bioclip_yolo/overlays/', o.image_id, '_overlay.jpg') AS overlay_path,
         o.species_label AS ground_truth_species, 'correct' AS correct"""


@query(f"""WITH {OWN}, {LOCALISED_BOXES}
SELECT {_RECORD}
FROM own o JOIN v_gallery g ON o.image_id = g.image_id
JOIN localised_boxes l ON o.image_id = l.image_id
WHERE o.rn <= 15""")
def detect_job(spark, sf_dir):
    """Top images of every label, located and judged."""
    images = _gallery(spark, sf_dir)
    truth = images.select("image_id", "species_label", "seq")
    return jobs.detect_all_species(
        images, view(spark, sf_dir, "v_prompts"), boxes(spark, sf_dir), truth, "bioclip_yolo"
    )


@query(f"""WITH {OWN}, {LOCALISED_BOXES}
SELECT {_RECORD}
FROM own o JOIN v_gallery g ON o.image_id = g.image_id
JOIN localised_boxes l ON o.image_id = l.image_id
WHERE o.rn <= 15 AND o.species_label = '4'""")
def detect_one_species(spark, sf_dir):
    images = _gallery(spark, sf_dir)
    truth = images.select("image_id", "species_label", "seq")
    return jobs.detect(
        images, view(spark, sf_dir, "v_prompts"), boxes(spark, sf_dir), truth, "bioclip_yolo", "4"
    )


@query(f"""WITH {OWN}, {LOCALISED_BOXES}
SELECT {_RECORD}
FROM own o JOIN v_gallery g ON o.image_id = g.image_id
JOIN localised_boxes l ON o.image_id = l.image_id
WHERE o.rn <= 15 AND o.species_label = '4'""")
def detect_files(spark, sf_dir):
    """From stored metadata to stored detections."""
    path, images = scratch_dir(spark, "metadata"), _gallery(spark, sf_dir)
    sinks.write_enriched_images(images.drop("seq", "embedding"), path, "parquet")
    return jobs.detect_stored(
        spark,
        path,
        images,
        view(spark, sf_dir, "v_prompts"),
        boxes(spark, sf_dir),
        "bioclip_yolo",
        "4",
        scratch_dir(spark, "detections"),
        "parquet",
    )


def _csv_in_order(spark, sf_dir):
    """The gallery's metadata as CSV files, in the order of ``seq``."""
    path, images = scratch_dir(spark, "metadata"), _gallery(spark, sf_dir)
    rows = images.repartitionByRange(4, "seq").sortWithinPartitions("seq")
    rows.drop("seq", "embedding").write.option("header", True).csv(path)
    return path


def _archive(spark, sf_dir):
    """A listing in which every third image lies in a searched folder, others under the root."""
    name = F.concat("image_id", F.lit(".jpg"))
    own = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("/archive/one/"), name))
    path = own.otherwise(F.concat(F.lit("/study/"), "local_image_path"))
    return _gallery(spark, sf_dir).select(path.alias("path"))


_FOUND = """CASE WHEN g.seq % 3 = 0 THEN concat('/archive/one/', o.image_id, '.jpg')
              ELSE concat('/study/', g.local_image_path) END"""


@query(f"""WITH {OWN}, {LOCALISED_BOXES}
SELECT {_RECORD.replace("g.local_image_path AS", _FOUND + " AS")}
FROM own o JOIN v_gallery g ON o.image_id = g.image_id
JOIN localised_boxes l ON o.image_id = l.image_id
WHERE o.rn <= 15 AND o.species_label = '7'""")
def detect_csv(spark, sf_dir):
    """As users run it: metadata from CSV in file order, paths looked up, records stored."""
    return jobs.detect_stored(
        spark,
        _csv_in_order(spark, sf_dir),
        _gallery(spark, sf_dir),
        view(spark, sf_dir, "v_prompts"),
        boxes(spark, sf_dir),
        "bioclip_yolo",
        "7",
        scratch_dir(spark, "detections"),
        files=_archive(spark, sf_dir),
        root="/study",
        directories=["/archive/one"],
    )


@query("""SELECT image_id, species_label,
  CAST(row_number() OVER (ORDER BY seq) - 1 AS BIGINT) AS seq FROM v_gallery""")
def images_in_file_order(spark, sf_dir):
    """Every image with its place in the CSV files, read in many small splits."""
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    path = _csv_in_order(spark, sf_dir)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = tables.read_images(spark, path, ordered=True)
        return stored(rows.select("image_id", "species_label", "seq"), "placed")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


@query(f"""WITH {TOP1},
first AS (SELECT *, row_number() OVER (PARTITION BY species_label ORDER BY seq) AS place
          FROM v_gallery),
rated AS (SELECT t.true_species, t.correct FROM top1 t JOIN first g ON t.image_id = g.image_id
          WHERE g.place <= 40)
SELECT true_species, count(*) AS images, count(*) FILTER (correct) AS correct
FROM rated GROUP BY true_species""")
def evaluate_csv(spark, sf_dir):
    """From CSV to stored evaluation rows; heads of labels are the first rows of the files."""
    done = jobs.evaluate_stored(
        spark,
        _csv_in_order(spark, sf_dir),
        _gallery(spark, sf_dir),
        view(spark, sf_dir, "v_prompts"),
        scratch_dir(spark, "evaluation"),
        per_species=40,
    )
    return done.rows.groupBy("true_species").agg(
        F.count("*").alias("images"), F.count_if("correct").alias("correct")
    )


@query(f"""WITH {OWN}, {LOCALISED_BOXES},
chosen AS (SELECT image_id FROM own WHERE rn <= 40 AND species_label = '4'),
found AS (
  SELECT 'bioclip_yolo' AS pipeline, l.instance_count, l.detection_quality
  FROM localised_boxes l JOIN chosen c ON l.image_id = c.image_id
  UNION ALL
  SELECT 'bioclip_sam', CAST(count(m.image_id) AS INT),
         coalesce(max(coalesce(m.conf, CASE WHEN m.image_id IS NULL THEN 0 ELSE 1 END)), 0)
  FROM chosen c LEFT JOIN v_masks m ON c.image_id = m.image_id GROUP BY c.image_id
  UNION ALL
  SELECT 'bioclip_megadetector', CAST(count(b.image_id) AS INT),
         coalesce(max(b.conf), 0)
  FROM chosen c LEFT JOIN (SELECT * FROM v_boxes
                           WHERE class_id BETWEEN 16 AND 25 AND conf >= 0.2) b
    ON c.image_id = b.image_id GROUP BY c.image_id)
SELECT pipeline, count(*) AS processed, count(*) FILTER (instance_count > 0) AS localised,
       round(1e-9 + avg(round(1e-9 + detection_quality, 4)), 4) AS mean_quality
FROM found GROUP BY pipeline""")
def compare_job(spark, sf_dir):
    """Three detectors on the same ranked images, side by side."""
    return _compared(spark, sf_dir).metrics.select(
        "pipeline", "processed", "localised", round4("mean_quality").alias("mean_quality")
    )


@query(f"""WITH {OWN}
SELECT g.local_image_path AS image_path,
  concat('results/bioclip_sam/overlays/', o.image_id, '_overlay.jpg') AS bioclip_sam,
  concat('results/bioclip_yolo/overlays/', o.image_id, '_overlay.jpg') AS bioclip_yolo,
  concat('results/bioclip_megadetector/overlays/', o.image_id, '_overlay.jpg')
    AS bioclip_megadetector,
  concat(o.image_id, '_compare.jpg') AS compare_name
FROM own o JOIN v_gallery g ON o.image_id = g.image_id
WHERE o.rn <= 40 AND o.species_label = '4'""")
def compare_job_overlays(spark, sf_dir):
    return _compared(spark, sf_dir).overlays


def _compared(spark, sf_dir):
    images = _gallery(spark, sf_dir)
    truth = images.select("image_id", "species_label", "seq")
    runs = view(spark, sf_dir, "v_detections").groupBy("pipeline").agg(
        (F.count("*") * 0.125).alias("elapsed_s")
    )
    raw = {
        "bioclip_sam": view(spark, sf_dir, "v_masks"),
        "bioclip_yolo": boxes(spark, sf_dir),
        "bioclip_megadetector": boxes(spark, sf_dir),
    }
    return jobs.compare_pipelines(
        images, view(spark, sf_dir, "v_prompts"), raw, truth, runs, "4", 40
    )


@query(f"""WITH {TOP1}
SELECT t.image_id, g.local_image_path AS image_path, t.true_species, t.predicted_species,
       t.correct, t.top1_score, t.true_species_score, g.site_id AS camera_id, g.latitude,
       g.longitude
FROM top1 t JOIN v_gallery g ON t.image_id = g.image_id""")
def evaluate_rows(spark, sf_dir):
    return jobs.evaluation_rows(
        _gallery(spark, sf_dir), view(spark, sf_dir, "v_prompts"), wide=False
    )


_WIDE = ", ".join(
    f"round(1e-9 + max(CASE WHEN s.species = '{i}' THEN s.score END), 4) AS score_{i}"
    for i in range(10)
)


@query(f"""WITH {TOP1}
SELECT t.image_id,
       CASE g.seq % 4 WHEN 0 THEN concat('/study/', g.local_image_path)
            ELSE concat('/archive/one/', t.image_id, '.jpg') END AS image_path,
       t.true_species, t.predicted_species, t.correct, t.top1_score, t.true_species_score,
       g.site_id AS camera_id, g.latitude, g.longitude, {_WIDE}
FROM top1 t JOIN v_gallery g ON t.image_id = g.image_id JOIN scores s ON t.image_id = s.image_id
WHERE g.seq % 4 < 2
GROUP BY ALL""")
def evaluate_files(spark, sf_dir):
    """The whole evaluation: every image, paths found in a listing, wide scores."""
    images, name = _gallery(spark, sf_dir), F.concat("image_id", F.lit(".jpg"))
    listing = images.select(
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit("/study/"), "local_image_path"))
        .when(F.col("seq") % 4 == 1, F.concat(F.lit("/archive/one/"), name))
        .otherwise(F.concat(F.lit("/elsewhere/"), name))
        .alias("path")
    )
    return jobs.evaluation_rows(
        images,
        view(spark, sf_dir, "v_prompts"),
        listing,
        root="/study",
        directories=["/archive/one", "/archive/two"],
    )


_EVALUATION_LINES = fixed_lines(
    s0=["=" * 62, "BioCLIP Multi-Species Evaluation — Top-1 Accuracy", "=" * 62, ""],
    s2=["", f"{'Species':<22} {'Images':>8} {'Correct':>9} {'Accuracy':>10}", "-" * 62],
    s4=["=" * 62, "", "Incorrect predictions (top misclassifications):", "-" * 62],
    s6=["", "Full results: evaluation.parquet"],
)


@query(f"""WITH {TOP1},
species AS (
  SELECT true_species, count(*) AS n, count(*) FILTER (correct) AS c FROM top1
  GROUP BY true_species),
wrong AS (
  SELECT true_species, predicted_species, count(*) AS times FROM top1 WHERE NOT correct
  GROUP BY 1, 2 ORDER BY times DESC, 1, 2 LIMIT 10)
SELECT 1 AS section, CAST(0 AS DOUBLE) AS rank,
       printf('%-36s %d', 'Total images evaluated:', count(*)) AS text FROM top1
UNION ALL
SELECT 1, 1, printf('%-36s %d', 'Correct (top-1):', count(*) FILTER (correct)) FROM top1
UNION ALL
SELECT 1, 2, printf('%-36s %.1f%%', 'Overall top-1 accuracy:',
                    CAST(100.0 * count(*) FILTER (correct) / count(*) AS DOUBLE)) FROM top1
UNION ALL
SELECT 3, CAST(true_species AS INT) + 1,
       printf('%-22s %8d %9d %9.1f%% %s', true_species, n, c, CAST(100.0 * c / n AS DOUBLE),
              CASE WHEN 100.0 * c / n >= 50 THEN '✓' ELSE '✗' END) FROM species
UNION ALL
SELECT 5, -times, printf('  %-18s → %-18s (%d times)', true_species, predicted_species, times)
FROM wrong
UNION ALL
SELECT 5, 0, '  (no incorrect predictions)' WHERE NOT EXISTS (SELECT * FROM wrong)
UNION ALL {_EVALUATION_LINES}""")
def evaluate_job(spark, sf_dir):
    """Scored once and stored; the page is made from what was stored."""
    path = scratch_dir(spark, "evaluation")
    scored = jobs.evaluation_rows(
        _gallery(spark, sf_dir), view(spark, sf_dir, "v_prompts"), wide=False
    )
    sinks.write_evaluation(scored, path)
    done = jobs.summarise_evaluation(
        tables.read_evaluation(spark, path),
        [r.species for r in view(spark, sf_dir, "v_prompts").orderBy("ord").collect()],
        "evaluation.parquet",
    )
    return done.report.select("section", "rank", "text")


MODELS = f"""
{TOP1},
localisation AS (
  SELECT even_id AS image_id, CASE WHEN instance_count > 0 THEN detection_quality ELSE 0 END
           AS quality
  FROM (
    SELECT *, CAST(CAST(image_id AS BIGINT) - CAST(image_id AS BIGINT) % 2 AS VARCHAR) AS even_id,
           row_number() OVER (PARTITION BY CAST(image_id AS BIGINT) - CAST(image_id AS BIGINT) % 2
                              ORDER BY seq DESC) AS rn
    FROM v_detections WHERE pipeline = 'bioclip_sam') WHERE rn = 1),
models AS (
  SELECT t.image_id, t.true_species, t.predicted_species AS bioclip_predicted,
         t.correct AS bioclip_correct, coalesce(l.quality > 0, FALSE) AS megadetector_localised,
         t.correct AND coalesce(l.quality > 0, FALSE) AS combined_correct
  FROM top1 t LEFT JOIN localisation l ON t.image_id = l.image_id)
"""


def _localised(spark, sf_dir):
    """Localisation that repeats even images and leaves out odd ones; the last row counts."""
    number = F.col("image_id").cast("bigint")
    return (
        view(spark, sf_dir, "v_detections")
        .filter("pipeline = 'bioclip_sam'")
        .select(
            (number - number % 2).cast("string").alias("image_id"),
            "seq",
            (F.col("instance_count") > 0).alias("has_mask"),
            F.col("detection_quality").alias("quality"),
            F.col("pipeline").alias("backend"),
        )
    )


def _model_rows(spark, sf_dir):
    prompts = view(spark, sf_dir, "v_prompts")
    return jobs.model_rows(_gallery(spark, sf_dir), prompts, _localised(spark, sf_dir))


@query(f"""WITH {MODELS}
SELECT true_species, round(1e-9 + 100 * avg(CAST(bioclip_correct AS INT)), 4)
         AS identification_pct,
       round(1e-9 + 100 * avg(CAST(megadetector_localised AS INT)), 4) AS localisation_pct,
       round(1e-9 + 100 * avg(CAST(combined_correct AS INT)), 4) AS combined_pct,
       count(*) AS images,
       CASE WHEN avg(CAST(bioclip_correct AS INT)) > avg(CAST(megadetector_localised AS INT))
            THEN 'BioCLIP' ELSE 'MegaDetector' END AS winner
FROM models GROUP BY true_species""")
def models_job(spark, sf_dir):
    """Identification by vectors against localisation by one pipeline."""
    rows = _model_rows(spark, sf_dir)
    done = jobs.summarise_models(rows, [str(i) for i in range(10)])
    return done.by_species.withColumns(
        {c: round4(c) for c in ("identification_pct", "localisation_pct", "combined_pct")}
    )


@query(f"WITH {MODELS} SELECT * FROM models")
def models_roundtrip(spark, sf_dir):
    """Model rows stored and read back with the declared schema."""
    path = scratch_dir(spark, "models")
    sinks.write_model_comparison(_model_rows(spark, sf_dir), path)
    return tables.read_comparison(spark, path).select(
        "image_id",
        "true_species",
        "bioclip_predicted",
        "bioclip_correct",
        "megadetector_localised",
        "combined_correct",
    )


def _models_stored(spark, sf_dir):
    path = scratch_dir(spark, "models")
    metadata, images = _csv_in_order(spark, sf_dir), _gallery(spark, sf_dir)
    prompts = view(spark, sf_dir, "v_prompts")
    return path, jobs.models_stored(spark, metadata, images, prompts, _localised(spark, sf_dir), path)


@query(f"""WITH {MODELS}
SELECT s.stage, count(*) AS images, count(*) FILTER (s.good) AS correct,
       round(1e-9 + 100.0 * count(*) FILTER (s.good) / count(*), 4) AS rate_pct
FROM models, LATERAL (VALUES ('identification', bioclip_correct), ('localisation', megadetector_localised),
                             ('combined', combined_correct)) s(stage, good)
GROUP BY s.stage""")
def models_files(spark, sf_dir):
    """From CSV metadata to stored rows; the rates from one tally of them."""
    _, done = _models_stored(spark, sf_dir)
    return done.metrics.withColumn("rate_pct", round4("rate_pct"))


@query(f"""WITH {MODELS}
SELECT true_species, bioclip_predicted AS predicted_species, count(*) AS times
FROM models WHERE NOT bioclip_correct GROUP BY ALL ORDER BY times DESC, 1, 2 LIMIT 8""")
def models_files_confusions(spark, sf_dir):
    """The most frequent confusions from the same tally."""
    return _models_stored(spark, sf_dir)[1].confusions


@query(f"""WITH {ERRORS}
SELECT species, pipeline, {_COUNT_ACCURACY} FROM errors GROUP BY species, pipeline""")
def counts_job(spark, sf_dir):
    """Counting accuracy of every label and pipeline in one pass."""
    images = view(spark, sf_dir, "v_images").select("image_id", "species_label")
    done = jobs.enrich_images(images, view(spark, sf_dir, "v_annotations"), "seq")
    rows = view(spark, sf_dir, "v_detections")
    return rounded_accuracy(jobs.evaluate_all_counts(rows, done.images))


@query(f"""WITH {ERRORS}
SELECT pipeline, {_COUNT_ACCURACY} FROM errors WHERE species = 'view' GROUP BY pipeline""")
def counts_of_species(spark, sf_dir):
    images = view(spark, sf_dir, "v_images").select("image_id", "species_label")
    done = jobs.enrich_images(images, view(spark, sf_dir, "v_annotations"), "seq")
    counted = jobs.evaluate_counts(view(spark, sf_dir, "v_detections"), done.images, "view")
    return rounded_accuracy(counted.accuracy)


@query(f"""WITH {ENRICHED}
SELECT image_id, ground_truth_count, ground_truth_count_num FROM enriched""")
def enrich_job(spark, sf_dir):
    """Enriched metadata written in place of the plain one and read back."""
    path = scratch_dir(spark, "metadata")
    sinks.write_enriched_images(
        view(spark, sf_dir, "v_images").drop("seq"), path, "parquet"
    )
    done = jobs.enrich_images(
        tables.read_images(spark, path, "parquet"), view(spark, sf_dir, "v_annotations"), "seq"
    )
    sinks.write_enriched_images(done.images, path, "parquet")
    stored = tables.read_images(spark, path, "parquet", enriched=True)
    return stored.select("image_id", "ground_truth_count", "ground_truth_count_num")


@query(f"""WITH {ENRICHED}
SELECT image_id, ground_truth_count, ground_truth_count_num FROM enriched""")
def enrich_bucketed(spark, sf_dir):
    """Images and annotations kept in buckets by image, joined where they lie."""
    name, path = f"in_buckets_{uuid.uuid4().hex}", scratch_dir(spark, "buckets")
    images = view(spark, sf_dir, "v_images").select("image_id", "species_label")
    images = sinks.write_bucketed(images, f"{name}_images", f"{path}/images", 8)
    annotations = view(spark, sf_dir, "v_annotations")
    annotations = sinks.write_bucketed(annotations, f"{name}_annotations", f"{path}/annotations", 8)
    done = joins.enrich_ground_truth(images, annotations, "seq")
    return done.select("image_id", "ground_truth_count", "ground_truth_count_num")


def _annotation_documents(spark, sf_dir):
    """The annotations as JSON documents of up to 1,000, one a line, in their order."""
    path = scratch_dir(spark, "annotations")
    rows = view(spark, sf_dir, "v_annotations").select(
        F.floor(F.col("seq") / 1000).alias("part"), "seq", F.struct("image_id", "count", "standing").alias("a")
    )
    entries = F.array_sort(F.collect_list(F.struct("seq", "a")))
    documents = rows.groupBy("part").agg(F.transform(entries, lambda e: e["a"]).alias("annotations"))
    documents.repartitionByRange(4, "part").sortWithinPartitions("part").select("annotations").write.json(path)
    return path


def _enriched_from_files(spark, sf_dir):
    path = scratch_dir(spark, "metadata")
    images = view(spark, sf_dir, "v_images").drop("seq")
    sinks.write_enriched_images(images, path)
    return jobs.enrich_stored(spark, path, _annotation_documents(spark, sf_dir), lines=True)


@query(f"""WITH {ENRICHED}
SELECT image_id, ground_truth_count, ground_truth_count_num FROM enriched""")
def enrich_files(spark, sf_dir):
    """From CSV metadata and JSON annotations to the next version of the CSV."""
    done = _enriched_from_files(spark, sf_dir)
    return done.images.select("image_id", "ground_truth_count", "ground_truth_count_num")


@query(f"""WITH {ENRICHED}
SELECT count(ground_truth_count) AS matched, count(*) AS total,
       round(1e-9 + 100.0 * count(ground_truth_count) / count(*), 4) AS match_pct FROM enriched""")
def enrich_files_match_rate(spark, sf_dir):
    """Matches as counted while the metadata was written."""
    return _enriched_from_files(spark, sf_dir).match_rate.withColumn("match_pct", round4("match_pct"))


def _compared_files(spark, sf_dir):
    path = scratch_dir(spark, "comparison")
    runs = view(spark, sf_dir, "v_detections").groupBy("pipeline").agg((F.count("*") * 0.125).alias("elapsed_s"))
    raw = {"bioclip_sam": view(spark, sf_dir, "v_masks"), "bioclip_yolo": boxes(spark, sf_dir), "bioclip_megadetector": boxes(spark, sf_dir)}
    metadata, images = _csv_in_order(spark, sf_dir), _gallery(spark, sf_dir)
    return path, jobs.compare_stored(spark, metadata, images, view(spark, sf_dir, "v_prompts"), raw, runs, "4", path, top_n=40)


@query(f"""WITH {OWN},
chosen AS (SELECT image_id, round(1e-9 + CASE WHEN high > low THEN (score - low) / (high - low) ELSE 1 END, 4) AS confidence
           FROM own WHERE rn <= 40 AND species_label = '4')
SELECT image_id, pipeline, confidence, concat('images/', image_id, '.jpg') AS image_path
FROM chosen, (VALUES ('bioclip_sam'), ('bioclip_yolo'), ('bioclip_megadetector')) p(pipeline)""")
def compare_merged(spark, sf_dir):
    """The comparison's merged CSV, read back."""
    path, _ = _compared_files(spark, sf_dir)
    merged = tables.read_detections_csv(spark, f"{path}/merged")
    return merged.select("image_id", "pipeline", "confidence", "image_path")


@query(f"""WITH {OWN}
SELECT CAST(1 AS INT) AS line, 'Pipeline 1 Comparison Report  |  Species: 4' AS text
UNION ALL
SELECT 4, printf('%-28s %13s %14s %8s', 'Metric', 'BioCLIP+SAM', 'BioCLIP+YOLO', 'SAM 3')
UNION ALL
SELECT 6, printf('%-28s %13s %14s %8s', 'Images processed', n, n, n)
FROM (SELECT CAST(count(*) AS VARCHAR) AS n FROM own WHERE rn <= 40 AND species_label = '4')""")
def compare_page(spark, sf_dir):
    """Title, headings and first metric of the comparison's stored page."""
    path, _ = _compared_files(spark, sf_dir)
    page = files.read_report(spark, f"{path}/report").splitlines()
    return spark.createDataFrame([(k, page[k]) for k in (1, 4, 6)], "line int, text string")
