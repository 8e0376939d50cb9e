"""Queries on side-by-side comparisons of pipelines and models."""

from pyspark.sql import functions as F

from spoorline.driver.registry import fixed_lines, query, round4
from spoorline.driver.views import view
from spoorline.functions import measures
from spoorline.operators import aggregates, joins, reports, sets

# Identification comes from one pipeline and localisation from another, whose rows
# repeat every even image and leave out every odd one: the last row counts.
COMBINED = """
last_localised AS (
  SELECT * FROM (
    SELECT *, CAST(CAST(image_id AS BIGINT) - CAST(image_id AS BIGINT) % 2 AS VARCHAR) AS even_id,
           row_number() OVER (PARTITION BY CAST(image_id AS BIGINT) - CAST(image_id AS BIGINT) % 2
                              ORDER BY seq DESC) AS rn
    FROM v_detections WHERE pipeline = 'bioclip_megadetector') WHERE rn = 1),
combined AS (
  SELECT i.image_id, i.ground_truth_species AS true_species,
         i.species AS bioclip_predicted, i.species = i.ground_truth_species AS bioclip_correct,
         coalesce(l.location <> 'no_detection' AND l.detection_quality > 0, FALSE)
           AS megadetector_localised,
         round(1e-9 + coalesce(l.detection_quality, 0), 4) AS megadetector_quality,
         coalesce(l.pipeline, 'unknown') AS megadetector_backend,
         i.species = i.ground_truth_species
           AND coalesce(l.location <> 'no_detection' AND l.detection_quality > 0, FALSE)
           AS combined_correct
  FROM (SELECT * FROM v_detections WHERE pipeline = 'bioclip_sam') i
  LEFT JOIN last_localised l ON i.image_id = l.even_id)
"""


def combined(spark, sf_dir):
    rows = view(spark, sf_dir, "v_detections")
    identification = rows.filter("pipeline = 'bioclip_sam'").select(
        "image_id",
        F.col("ground_truth_species").alias("true_species"),
        F.col("species").alias("bioclip_predicted"),
        (F.col("species") == F.col("ground_truth_species")).alias("bioclip_correct"),
        "seq",
    )
    number = F.col("image_id").cast("bigint")
    localisation = rows.filter("pipeline = 'bioclip_megadetector'").select(
        (number - number % 2).cast("string").alias("image_id"),
        measures.mask_localised(
            measures.is_localised("location"), "detection_quality"
        ).alias("megadetector_localised"),
        round4("detection_quality").alias("megadetector_quality"),
        F.col("pipeline").alias("megadetector_backend"),
        "seq",
    )
    return joins.combine_identification_localisation(identification, localisation, "seq")


@query(f"WITH {COMBINED} SELECT * FROM combined")
def combine_models(spark, sf_dir):
    return combined(spark, sf_dir)


# Seconds of each stage: invented from the rows, so that they grow with the data.
_STAGE_RUNS = """
stage_runs AS (
  SELECT 'identification' AS stage, count(*) * CAST(0.5 AS DOUBLE) AS elapsed_s
  FROM v_detections WHERE pipeline = 'bioclip_sam'
  UNION ALL
  SELECT 'localisation', count(*) * CAST(0.25 AS DOUBLE)
  FROM v_detections WHERE pipeline = 'bioclip_megadetector')
"""


def stage_runs(spark, sf_dir):
    rows = view(spark, sf_dir, "v_detections")
    stage = F.when(F.col("pipeline") == "bioclip_sam", "identification").when(
        F.col("pipeline") == "bioclip_megadetector", "localisation"
    )
    per_row = F.when(F.col("pipeline") == "bioclip_sam", 0.5).otherwise(0.25)
    return (
        rows.select(stage.alias("stage"), per_row.alias("s"))
        .dropna(subset=["stage"])
        .groupBy("stage")
        .agg(F.sum("s").alias("elapsed_s"))
    )


MODEL_COMPARISON = f"""
{COMBINED}, {_STAGE_RUNS},
counted AS (
  SELECT 'identification' AS stage, count(*) AS images,
         count(*) FILTER (bioclip_correct) AS correct FROM combined
  UNION ALL
  SELECT 'localisation', count(*), count(*) FILTER (megadetector_localised) FROM combined
  UNION ALL
  SELECT 'combined', count(*), count(*) FILTER (combined_correct) FROM combined),
model_comparison AS (
  SELECT c.stage, c.images, c.correct, 100.0 * c.correct / c.images AS rate_pct, r.elapsed_s,
         r.elapsed_s / greatest(c.images, 1) AS seconds_per_image
  FROM counted c LEFT JOIN stage_runs r ON c.stage = r.stage)
"""


@query(f"""WITH {MODEL_COMPARISON}
SELECT stage, images, correct, round(1e-9 + rate_pct, 4) AS rate_pct, elapsed_s,
       round(1e-9 + seconds_per_image, 4) AS seconds_per_image FROM model_comparison""")
def model_comparison(spark, sf_dir):
    out = aggregates.model_comparison(combined(spark, sf_dir), stage_runs(spark, sf_dir))
    return out.withColumns({c: round4(c) for c in ("rate_pct", "seconds_per_image")})


@query(f"""WITH {COMBINED},
rates AS (
  SELECT true_species, 100 * avg(CAST(bioclip_correct AS INT)) AS a,
         100 * avg(CAST(megadetector_localised AS INT)) AS b,
         100 * avg(CAST(combined_correct AS INT)) AS c, count(*) AS images
  FROM combined GROUP BY true_species)
SELECT true_species, round(1e-9 + a, 4) AS identification_pct,
       round(1e-9 + b, 4) AS localisation_pct,
       round(1e-9 + c, 4) AS combined_pct, images,
       CASE WHEN a > b THEN 'BioCLIP' ELSE 'MegaDetector' END AS winner
FROM rates""")
def model_comparison_by_species(spark, sf_dir):
    out = aggregates.model_comparison_by_species(combined(spark, sf_dir))
    return out.withColumns(
        {c: round4(c) for c in ("identification_pct", "localisation_pct", "combined_pct")}
    )


LABELS = ["click", "error", "purchase", "signup", "view"]
_MODEL_LINES = fixed_lines(
    s0=[
        "=" * 70,
        "BioCLIP vs SAM 3 — Comparison Report",
        "=" * 70,
        "",
        f"{'Metric':<40} {'BioCLIP':>10} {'SAM 3':>8} {'Combined':>10}",
        "-" * 70,
    ],
    s2=[
        "",
        "What these numbers mean:",
        "  BioCLIP accuracy   = % images where top-1 species prediction is correct",
        "  SAM 3 localisation = % images where SAM 3 found a valid mask",
        "                       (given the correct species name as prompt)",
        "  Combined           = both BioCLIP identified AND SAM 3 localised",
        "",
        f"{'Species':<22} {'BioCLIP':>10} {'SAM 3':>8} {'Combined':>10} {'N':>4}",
        "-" * 70,
    ],
    s4=["", "Top BioCLIP misclassifications:", "-" * 70],
    s6=["=" * 70],
)
_COMPARISON_LINES = fixed_lines(
    s0=[
        "=" * 66,
        "Pipeline 1 Comparison Report  |  Species: all",
        "=" * 66,
        "",
        f"{'Metric':<28} {'BioCLIP+SAM':>13} {'BioCLIP+YOLO':>14} {'SAM 3':>8}",
        "-" * 66,
    ],
    s2=[
        "=" * 66,
        "",
        "BioCLIP+SAM  : best spatial precision (pixel mask, SAM 1).",
        "BioCLIP+YOLO : fastest; bounding boxes for large-scale runs.",
        "SAM 3        : text-prompted concept segmentation, single model.",
    ],
)


@query(f"""WITH {MODEL_COMPARISON},
cells AS (
  SELECT 0 AS i, 'Images evaluated' AS label, stage, CAST(images AS VARCHAR) AS v
  FROM model_comparison
  UNION ALL
  SELECT 1, 'Correct / Localised', stage, CAST(correct AS VARCHAR) FROM model_comparison
  UNION ALL
  SELECT 2, 'Accuracy / Localisation rate', stage, printf('%.1f%%', CAST(rate_pct AS DOUBLE))
  FROM model_comparison
  UNION ALL
  SELECT 3, 'Total runtime', stage, coalesce(printf('%.1fs', elapsed_s), '—')
  FROM model_comparison
  UNION ALL
  SELECT 4, 'Avg time per image', stage, coalesce(printf('%.2fs', seconds_per_image), '—')
  FROM model_comparison),
species AS (
  SELECT true_species, 100 * avg(CAST(bioclip_correct AS INT)) AS a,
         100 * avg(CAST(megadetector_localised AS INT)) AS b,
         100 * avg(CAST(combined_correct AS INT)) AS c, count(*) AS n
  FROM combined GROUP BY true_species),
wrong AS (
  SELECT true_species, bioclip_predicted, count(*) AS times FROM combined
  WHERE NOT bioclip_correct GROUP BY 1, 2 ORDER BY times DESC, 1, 2 LIMIT 8)
SELECT 1 AS section, CAST(i AS DOUBLE) AS rank,
       concat(printf('%-40s', label), ' ',
              lpad(max(CASE stage WHEN 'identification' THEN v END), 10, ' '), ' ',
              lpad(max(CASE stage WHEN 'localisation' THEN v END), 8, ' '), ' ',
              lpad(max(CASE stage WHEN 'combined' THEN v END), 10, ' ')) AS text
FROM cells GROUP BY i, label
UNION ALL
SELECT 3, list_position({LABELS}, true_species),
       printf('%-22s %10s %8s %10s %4d', true_species, printf('%.1f%%', a),
              printf('%.1f%%', b), printf('%.1f%%', c), n)
FROM species
UNION ALL
SELECT 5, -times, printf('  %-18s -> %-18s (%d times)', true_species, bioclip_predicted, times)
FROM wrong
UNION ALL {_MODEL_LINES}""")
def model_report_lines(spark, sf_dir):
    """Every line of the model comparison page."""
    rows = combined(spark, sf_dir)
    lines = reports.model_report(
        aggregates.model_comparison(rows, stage_runs(spark, sf_dir)),
        aggregates.model_comparison_by_species(rows),
        aggregates.confusions(rows, 8, "bioclip_predicted", "bioclip_correct"),
        LABELS,
    )
    return lines.select("section", "rank", "text")


METHODS = """
method_runs AS (
  SELECT pipeline, count(*) * CAST(0.125 AS DOUBLE) AS elapsed_s FROM v_detections
  GROUP BY pipeline),
methods AS (
  SELECT pipeline, count(*) AS processed,
         count(*) FILTER (location NOT IN ('no_mask', 'no_detection', '')) AS localised,
         avg(confidence) AS mean_confidence, avg(detection_quality) AS mean_quality
  FROM v_detections GROUP BY pipeline),
compared AS (
  SELECT d.ord, d.pipeline, d.pipeline_label, coalesce(m.processed, 0) AS processed,
         coalesce(m.localised, 0) AS localised, m.mean_confidence, m.mean_quality,
         coalesce(r.elapsed_s, 0) AS elapsed_s,
         coalesce(r.elapsed_s, 0) / greatest(coalesce(m.processed, 0), 1)
           AS seconds_per_image
  FROM (VALUES (0, 'bioclip_sam', 'BioCLIP + SAM 3'), (1, 'bioclip_yolo', 'BioCLIP + YOLO'),
               (2, 'bioclip_megadetector', 'BioCLIP + MegaDetector'))
       d(ord, pipeline, pipeline_label)
  LEFT JOIN methods m ON d.pipeline = m.pipeline
  LEFT JOIN method_runs r ON d.pipeline = r.pipeline)
"""


def comparison(spark, sf_dir):
    rows = view(spark, sf_dir, "v_detections")
    runs = rows.groupBy("pipeline").agg((F.count("*") * 0.125).alias("elapsed_s"))
    return aggregates.pipeline_comparison(rows, runs)


@query(f"""WITH {METHODS}
SELECT ord, pipeline, pipeline_label, processed, localised,
       round(1e-9 + mean_confidence, 4) AS mean_confidence,
       round(1e-9 + mean_quality, 4) AS mean_quality,
       round(1e-9 + elapsed_s, 4) AS elapsed_s,
       round(1e-9 + seconds_per_image, 4) AS seconds_per_image
FROM compared""")
def method_comparison(spark, sf_dir):
    out = comparison(spark, sf_dir)
    rounded = ("mean_confidence", "mean_quality", "elapsed_s", "seconds_per_image")
    return out.withColumns({c: round4(c) for c in rounded})


@query(f"""WITH {METHODS}
SELECT m.pipeline, m.processed, m.localised, round(1e-9 + m.mean_quality, 4) AS mean_quality,
       d.pipeline_label,
       CASE m.pipeline WHEN 'bioclip_sam' THEN 'Multi-instance pixel masks'
                       WHEN 'bioclip_yolo' THEN 'Bounding box (single best)'
                       ELSE 'Multi-instance bounding boxes' END AS pipeline_output
FROM methods m JOIN compared d ON m.pipeline = d.pipeline""")
def method_cards(spark, sf_dir):
    out = aggregates.pipeline_cards(view(spark, sf_dir, "v_detections"))
    return out.withColumn("mean_quality", round4("mean_quality"))


@query(f"""WITH {METHODS}
SELECT 1 AS section, CAST(i AS DOUBLE) AS rank,
       printf('%-28s %13s %14s %8s', label, a, b, c) AS text
FROM (
  SELECT 0 AS i, 'Images processed' AS label,
         max(CASE ord WHEN 0 THEN CAST(processed AS VARCHAR) END) AS a,
         max(CASE ord WHEN 1 THEN CAST(processed AS VARCHAR) END) AS b,
         max(CASE ord WHEN 2 THEN CAST(processed AS VARCHAR) END) AS c FROM compared
  UNION ALL
  SELECT 1, 'Successful detections', max(CASE ord WHEN 0 THEN CAST(localised AS VARCHAR) END),
         max(CASE ord WHEN 1 THEN CAST(localised AS VARCHAR) END),
         max(CASE ord WHEN 2 THEN CAST(localised AS VARCHAR) END) FROM compared
  UNION ALL
  SELECT 2, 'Avg confidence',
         max(CASE ord WHEN 0 THEN printf('%.1f%%', 100 * mean_confidence) END),
         max(CASE ord WHEN 1 THEN printf('%.1f%%', 100 * mean_confidence) END),
         max(CASE ord WHEN 2 THEN printf('%.1f%%', 100 * mean_confidence) END) FROM compared
  UNION ALL
  SELECT 3, 'Avg detection quality', max(CASE ord WHEN 0 THEN printf('%.3f', mean_quality) END),
         max(CASE ord WHEN 1 THEN printf('%.3f', mean_quality) END),
         max(CASE ord WHEN 2 THEN printf('%.3f', mean_quality) END) FROM compared
  UNION ALL
  SELECT 4, 'Total runtime', max(CASE ord WHEN 0 THEN printf('%.1fs', elapsed_s) END),
         max(CASE ord WHEN 1 THEN printf('%.1fs', elapsed_s) END),
         max(CASE ord WHEN 2 THEN printf('%.1fs', elapsed_s) END) FROM compared
  UNION ALL
  SELECT 5, 'Avg time per image', max(CASE ord WHEN 0 THEN printf('%.1fs', seconds_per_image) END),
         max(CASE ord WHEN 1 THEN printf('%.1fs', seconds_per_image) END),
         max(CASE ord WHEN 2 THEN printf('%.1fs', seconds_per_image) END) FROM compared)
UNION ALL {_COMPARISON_LINES}""")
def text_report(spark, sf_dir):
    """Every line of the comparison page."""
    lines = reports.comparison_report(comparison(spark, sf_dir), "all")
    return lines.select("section", "rank", "text")


QUARTILES = """SELECT pipeline, count(*) AS n,
  round(min(detection_quality), 6) AS lowest,
  round(quantile_cont(detection_quality, 0.25), 6) AS lower_quartile,
  round(quantile_cont(detection_quality, 0.5), 6) AS median,
  round(quantile_cont(detection_quality, 0.75), 6) AS upper_quartile,
  round(max(detection_quality), 6) AS highest
FROM v_detections GROUP BY pipeline"""


@query(QUARTILES)
def quality_box_stats(spark, sf_dir):
    """Qualities are fractions of 997 here, so a pipeline has few different ones."""
    out = aggregates.quality_box_stats(view(spark, sf_dir, "v_detections"), few_values=True)
    return out.withColumns({c: F.round(c, 6) for c in aggregates.QUARTILE_NAMES})


@query(QUARTILES)
def quality_box_slices(spark, sf_dir):
    """The same for values of which there may be as many as rows."""
    out = aggregates.quality_box_stats(view(spark, sf_dir, "v_detections"))
    return out.withColumns({c: F.round(c, 6) for c in aggregates.QUARTILE_NAMES})


@query("""SELECT image_id, pipeline, location,
  CASE WHEN pipeline = 'bioclip_sam' THEN NULL ELSE detection_quality END AS detection_quality
FROM v_detections""")
def union_methods(spark, sf_dir):
    """One frame per pipeline, the first of them without a quality column."""
    rows = view(spark, sf_dir, "v_detections").select(
        "image_id", "pipeline", "location", "detection_quality"
    )
    parts = [
        rows.filter(F.col("pipeline") == "bioclip_sam").drop("detection_quality"),
        rows.filter(F.col("pipeline") == "bioclip_yolo"),
        None,
        rows.filter(F.col("pipeline") == "bioclip_megadetector"),
    ]
    return sets.union_pipelines(parts)


@query("""SELECT image_path,
  max(CASE WHEN pipeline = 'bioclip_sam' THEN overlay_path END) AS bioclip_sam,
  max(CASE WHEN pipeline = 'bioclip_yolo' THEN overlay_path END) AS bioclip_yolo,
  max(CASE WHEN pipeline = 'bioclip_megadetector' THEN overlay_path END)
    AS bioclip_megadetector,
  concat(replace(replace(image_path, 'images/', ''), '.jpg', ''), '_compare.jpg')
    AS compare_name
FROM v_detections GROUP BY image_path
HAVING count(*) FILTER (pipeline = 'bioclip_sam') > 0""")
def overlays_by_image(spark, sf_dir):
    return joins.overlays_by_image(view(spark, sf_dir, "v_detections"))
