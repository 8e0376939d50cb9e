"""Queries on ground truth, verdicts and names."""

from pyspark.sql import functions as F

from spoorline import fixed_values as fixed
from spoorline.driver.registry import fixed_lines, query, round4
from spoorline.driver.views import view
from spoorline.functions import measures
from spoorline.operators import aggregates, filters, joins, reports
from spoorline.session import scratch_dir
from spoorline.sources import files, sinks

LAST_LABEL = """
last_label AS (
  SELECT image_id, species_label FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY seq DESC) AS rn FROM v_labels)
  WHERE rn = 1)
"""
_DETECTION = "d.image_id, d.pipeline, d.species, d.confidence"


def detections(spark, sf_dir):
    return view(spark, sf_dir, "v_detections").select(
        "image_id", "pipeline", "species", "confidence"
    )


@query(f"""WITH {LAST_LABEL}
SELECT {_DETECTION}, coalesce(l.species_label, 'unknown') AS ground_truth_species,
       CASE WHEN l.species_label IS NULL THEN 'unknown'
            WHEN l.species_label = d.species THEN 'correct' ELSE 'incorrect' END AS correct
FROM v_detections d LEFT JOIN last_label l ON d.image_id = l.image_id""")
def with_ground_truth(spark, sf_dir):
    return joins.with_ground_truth(detections(spark, sf_dir), view(spark, sf_dir, "v_labels"))


@query(f"""WITH {LAST_LABEL}
SELECT {_DETECTION}, coalesce(l.species_label = d.species, FALSE) AS correct,
       d.location NOT IN ('no_mask', 'no_detection', '') AS localised
FROM v_detections d LEFT JOIN last_label l ON d.image_id = l.image_id""")
def derive_correct(spark, sf_dir):
    rows = view(spark, sf_dir, "v_detections").select(
        "image_id", "pipeline", "species", "confidence", "location"
    )
    return joins.derive_correct(rows, view(spark, sf_dir, "v_labels")).drop("location")


@query(f"""WITH {LAST_LABEL}
SELECT {_DETECTION}, coalesce(l.species_label = d.species, FALSE) AS correct,
       FALSE AS localised
FROM v_detections d LEFT JOIN last_label l ON d.image_id = l.image_id""")
def derive_correct_stored(spark, sf_dir):
    """From the stored verdict text instead of the labels."""
    stored = joins.with_ground_truth(detections(spark, sf_dir), view(spark, sf_dir, "v_labels"))
    return joins.derive_correct(stored).drop("ground_truth_species")


ENRICHED = """
last_annotation AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY seq DESC) AS rn
                 FROM v_annotations) WHERE rn = 1),
enriched AS (
  SELECT i.image_id, i.species_label,
         CASE WHEN a.image_id IS NOT NULL THEN coalesce(a.count, '1') END
           AS ground_truth_count,
         CAST(CASE WHEN a.image_id IS NULL THEN NULL
              WHEN a.count = '11-50' THEN 15 WHEN a.count = '51+' THEN 51
              WHEN a.count IN ('1', '2', '3', '4', '5', '6', '7', '8', '9', '10')
              THEN CAST(a.count AS INT) ELSE 1 END AS INT) AS ground_truth_count_num,
         CASE WHEN a.image_id IS NOT NULL THEN round(coalesce(a.standing, 0), 6) END
           AS gt_standing,
         CASE WHEN a.image_id IS NOT NULL THEN CAST(0 AS DOUBLE) END AS gt_moving
  FROM v_images i LEFT JOIN last_annotation a ON i.image_id = a.image_id)
"""


def enriched(spark, sf_dir):
    images = view(spark, sf_dir, "v_images").select("image_id", "species_label")
    return joins.enrich_ground_truth(images, view(spark, sf_dir, "v_annotations"), "seq")


@query(f"WITH {ENRICHED} SELECT * FROM enriched")
def enrich_ground_truth(spark, sf_dir):
    return enriched(spark, sf_dir).select(
        "image_id",
        "species_label",
        "ground_truth_count",
        "ground_truth_count_num",
        F.round("gt_standing", 6).alias("gt_standing"),
        "gt_moving",
    )


@query(f"""WITH {ENRICHED}
SELECT count(ground_truth_count) AS matched, count(*) AS total,
       round(1e-9 + 100.0 * count(ground_truth_count) / count(*), 4) AS match_pct FROM enriched""")
def match_rate(spark, sf_dir):
    out = aggregates.match_rate(enriched(spark, sf_dir))
    return out.withColumn("match_pct", round4("match_pct"))


@query(f"""WITH {ENRICHED}
SELECT ground_truth_count, count(*) AS images FROM enriched
WHERE ground_truth_count IS NOT NULL GROUP BY 1
ORDER BY images DESC, ground_truth_count LIMIT 15""")
def count_distribution(spark, sf_dir):
    return aggregates.count_distribution(enriched(spark, sf_dir))


@query(f"""WITH {ENRICHED}
SELECT image_id, ground_truth_count_num AS gt_count, ground_truth_count FROM enriched""")
def rename_gt(spark, sf_dir):
    return filters.rename_gt(enriched(spark, sf_dir))


ERRORS = f"""
{ENRICHED},
errors AS (
  SELECT d.image_id, d.pipeline, d.species, d.instance_count,
         e.ground_truth_count_num AS gt_count, e.ground_truth_count,
         CAST(abs(d.instance_count - e.ground_truth_count_num) AS DOUBLE) AS count_error,
         coalesce(d.instance_count = e.ground_truth_count_num, FALSE) AS exact_match
  FROM v_detections d LEFT JOIN enriched e ON d.image_id = e.image_id)
"""


def errors(spark, sf_dir):
    rows = view(spark, sf_dir, "v_detections").select(
        "image_id", "pipeline", "species", "instance_count"
    )
    return joins.count_errors(rows, joins.count_truth(enriched(spark, sf_dir)))


@query(f"WITH {ERRORS} SELECT * FROM errors")
def count_errors(spark, sf_dir):
    return errors(spark, sf_dir)


_COUNT_ACCURACY = """
  round(1e-9 + avg(instance_count), 4) AS mean_count, round(1e-9 + avg(gt_count), 4) AS mean_gt,
  round(1e-9 + avg(count_error), 4) AS mae,
  round(1e-9 + 100 * avg(CASE WHEN exact_match THEN 1.0 ELSE 0.0 END), 4) AS exact_pct
"""


def rounded_accuracy(df):
    return df.withColumns(
        {c: round4(c) for c in ("mean_count", "mean_gt", "mae", "exact_pct")}
    )


@query(f"WITH {ERRORS} SELECT pipeline, {_COUNT_ACCURACY} FROM errors GROUP BY pipeline")
def count_accuracy(spark, sf_dir):
    return rounded_accuracy(aggregates.count_accuracy(errors(spark, sf_dir)))


COUNT_LINES = fixed_lines(
    s0=[
        "=" * 72,
        "Pipeline 1 — Counting Accuracy Report  (all)",
        "=" * 72,
        "",
        f"{'Pipeline':<28} {'Mean Count':>10} {'GT Count':>9} {'MAE':>7} {'Exact %':>8}",
        "-" * 72,
    ],
    s2=[
        "",
        "What these numbers mean:",
        "  Mean Count  = average number of animals detected by the pipeline",
        "  GT Count    = average citizen scientist ground truth count",
        "  MAE         = mean absolute error (lower is better)",
        "  Exact %     = % of images where pipeline count exactly matches GT",
        "",
        "Interpretation:",
        "  MAE < 2  = acceptable for social structure classification",
        "  MAE > 5  = pipeline is significantly over or undercounting",
        "=" * 72,
    ],
)
COUNT_PAGE = f"""{ERRORS},
means AS (
  SELECT pipeline, avg(instance_count) AS a, avg(gt_count) AS b, avg(count_error) AS c,
         100 * avg(CAST(exact_match AS INT)) AS d
  FROM errors GROUP BY pipeline),
page AS (
SELECT 1 AS section,
       CAST(list_position(['bioclip_sam', 'bioclip_yolo', 'bioclip_megadetector'], pipeline)
            AS DOUBLE) AS rank,
       printf('%-28s %10.1f %9.1f %7.1f %7.1f%%', pipeline, a, b, c, d) AS text
FROM means
UNION ALL {COUNT_LINES})
"""


def count_page(spark, sf_dir):
    return reports.count_report(aggregates.count_accuracy(errors(spark, sf_dir)), "all")


@query(f"WITH {COUNT_PAGE} SELECT section, rank, text FROM page")
def count_report_lines(spark, sf_dir):
    """Every line of the counting page."""
    return count_page(spark, sf_dir).select("section", "rank", "text")


@query(f"""WITH {COUNT_PAGE}
SELECT row_number() OVER (ORDER BY section, rank) - 1 AS line, text FROM page""")
def report_roundtrip(spark, sf_dir):
    """A page stored as one text and read again."""
    path = scratch_dir(spark, "report")
    sinks.write_report(count_page(spark, sf_dir), path)
    lines = files.read_report(spark, path).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")


@query(f"""WITH repeated AS (
  SELECT image_id, CASE WHEN count = '11-50' THEN 15 WHEN count = '51+' THEN 51
                        WHEN count IS NULL THEN NULL
                        WHEN count IN ('1', '2', '3', '4', '5', '6', '7', '8', '9', '10')
                        THEN CAST(count AS INT) ELSE 1 END AS gt_count
  FROM v_annotations),
errors AS (
  SELECT d.pipeline, d.instance_count, r.gt_count,
         abs(d.instance_count - r.gt_count) AS count_error,
         coalesce(d.instance_count = r.gt_count, FALSE) AS exact_match
  FROM v_detections d LEFT JOIN repeated r ON d.image_id = r.image_id)
SELECT pipeline, {_COUNT_ACCURACY} FROM errors GROUP BY pipeline""")
def count_accuracy_repeated_truth(spark, sf_dir):
    """Truth with repeated images, whose joined rows are never built."""
    truth = view(spark, sf_dir, "v_annotations").select(
        "image_id",
        F.when(F.col("count").isNotNull(), measures.count_midpoint("count")).alias("gt_count"),
    )
    rows = view(spark, sf_dir, "v_detections")
    return rounded_accuracy(aggregates.count_accuracy_from(rows, truth))


_NAMED = """named AS (
  SELECT DISTINCT CASE seq % 16
      WHEN 0 THEN 'buffalo' WHEN 1 THEN 'cheetah' WHEN 2 THEN 'elephant' WHEN 3 THEN 'giraffe'
      WHEN 4 THEN 'leopard' WHEN 5 THEN 'wildebeest' WHEN 6 THEN 'zebra' WHEN 7 THEN 'lionmale'
      WHEN 8 THEN 'lionfemale' WHEN 9 THEN 'lioncub' WHEN 10 THEN 'hyenaspotted'
      WHEN 11 THEN 'hyenabrown' WHEN 12 THEN 'gazellethomsons' ELSE species_label END AS species
  FROM v_images)"""


@query(f"""WITH {_NAMED}
SELECT species,
  CASE species WHEN 'gazellethomsons' THEN 'Thomson''s Gazelle'
    WHEN 'hyenaspotted' THEN 'Spotted Hyena' WHEN 'hyenabrown' THEN 'Brown Hyena'
    WHEN 'lionmale' THEN 'Lion (male)' WHEN 'lionfemale' THEN 'Lion (female)'
    WHEN 'lioncub' THEN 'Lion (cub)' ELSE upper(species[1]) || species[2:] END AS display_name,
  CASE species WHEN 'gazellethomsons' THEN 'thomsons gazelle' WHEN 'lionfemale' THEN 'female lion'
    WHEN 'lionmale' THEN 'male lion' WHEN 'lioncub' THEN 'lion cub'
    WHEN 'hyenaspotted' THEN 'spotted hyena' WHEN 'hyenabrown' THEN 'brown hyena'
    ELSE species END AS concept_prompt,
  CASE species WHEN 'buffalo' THEN '0,165,255' WHEN 'cheetah' THEN '0,255,255'
    WHEN 'elephant' THEN '180,180,180' WHEN 'giraffe' THEN '0,200,0'
    WHEN 'leopard' THEN '255,0,180' WHEN 'wildebeest' THEN '255,80,0'
    WHEN 'zebra' THEN '255,255,255' WHEN 'lionmale' THEN '0,0,255'
    WHEN 'lionfemale' THEN '0,0,200' WHEN 'lioncub' THEN '0,0,150'
    WHEN 'hyenaspotted' THEN '255,0,255' WHEN 'hyenabrown' THEN '180,0,180'
    WHEN 'gazellethomsons' THEN '0,210,120' ELSE '0,200,255' END AS colour
FROM named""")
def with_display_names(spark, sf_dir):
    """All labels of the study and some that it does not know."""
    labels = F.array(*[F.lit(s) for s in fixed.TARGET_SPECIES])
    named = view(spark, sf_dir, "v_images").select(
        F.coalesce(F.get(labels, (F.col("seq") % 16).cast("int")), "species_label").alias("species")
    )
    return joins.with_display_names(named.distinct())


@query("""SELECT pipeline, CASE pipeline WHEN 'bioclip_sam' THEN 'BioCLIP + SAM 3'
    WHEN 'bioclip_yolo' THEN 'BioCLIP + YOLO' ELSE 'BioCLIP + MegaDetector' END AS pipeline_label,
  CASE pipeline WHEN 'bioclip_sam' THEN 'Multi-instance pixel masks'
    WHEN 'bioclip_yolo' THEN 'Bounding box (single best)'
    ELSE 'Multi-instance bounding boxes' END AS pipeline_output, count(*) AS n
FROM v_detections GROUP BY pipeline""")
def with_pipeline_names(spark, sf_dir):
    counted = view(spark, sf_dir, "v_detections").groupBy("pipeline").agg(F.count("*").alias("n"))
    return joins.with_pipeline_names(counted)


@query("""SELECT image_id, pipeline,
  CASE WHEN instance_count >= 6 THEN 'large herd' WHEN instance_count >= 2 THEN 'small group'
       WHEN instance_count = 1 THEN 'solitary' END AS social_structure
FROM v_detections""")
def social_structure(spark, sf_dir):
    size = measures.social_structure("instance_count").alias("social_structure")
    return view(spark, sf_dir, "v_detections").select("image_id", "pipeline", size)
