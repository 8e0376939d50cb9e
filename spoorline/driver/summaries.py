"""Queries behind the summary pages."""

from pyspark.sql import functions as F

from spoorline.driver.registry import query, round4
from spoorline.driver.views import view
from spoorline.operators import aggregates, filters, ranking

JUDGED = """
judged AS (
  SELECT d.*, d.species = d.ground_truth_species AS correct,
         d.location NOT IN ('no_mask', 'no_detection', '') AS localised
  FROM v_detections d)
"""
PLACED = f"""
{JUDGED},
placed AS (
  SELECT j.*, i.latitude, i.longitude, i.habitat_type
  FROM judged j LEFT JOIN v_images i ON j.image_id = i.image_id
  WHERE i.latitude IS NOT NULL AND i.longitude IS NOT NULL
    AND (i.latitude <> 0 OR i.longitude <> 0))
"""


def judged(spark, sf_dir):
    rows = view(spark, sf_dir, "v_detections")
    return filters.localised(
        rows.withColumn("correct", F.col("species") == F.col("ground_truth_species"))
    )


def placed(spark, sf_dir):
    sites = view(spark, sf_dir, "v_images").select(
        "image_id", "latitude", "longitude", "habitat_type"
    )
    return judged(spark, sf_dir).join(sites, "image_id", "left")


@query("SELECT species_label, count(*) AS images FROM v_images GROUP BY species_label")
def species_counts(spark, sf_dir):
    return aggregates.species_counts(view(spark, sf_dir, "v_images"))


@query("SELECT DISTINCT species_label AS species FROM v_images")
def available_species(spark, sf_dir):
    return aggregates.available_species(view(spark, sf_dir, "v_images"))


@query(f"""WITH {JUDGED}
SELECT i.images, i.species, i.sites, round(1e-9 + j.accuracy_pct, 4) AS accuracy_pct,
       j.pipelines_run
FROM (SELECT count(*) AS images, count(DISTINCT species_label) AS species,
             count(DISTINCT site_id) AS sites FROM v_images) i,
     (SELECT 100.0 * count(*) FILTER (correct) / count(*) AS accuracy_pct,
             count(DISTINCT pipeline) AS pipelines_run FROM judged) j""")
def dataset_overview(spark, sf_dir):
    out = aggregates.dataset_overview(view(spark, sf_dir, "v_images"), judged(spark, sf_dir))
    return out.withColumn("accuracy_pct", round4("accuracy_pct"))


_LABEL = """CASE pipeline WHEN 'bioclip_sam' THEN 'BioCLIP + SAM 3'
  WHEN 'bioclip_yolo' THEN 'BioCLIP + YOLO' ELSE 'BioCLIP + MegaDetector' END
  AS pipeline_label"""


@query(f"""SELECT pipeline, round(1e-9 + 100 * avg(confidence), 4) AS confidence_pct, {_LABEL}
FROM v_detections GROUP BY pipeline""")
def confidence_by_method(spark, sf_dir):
    out = aggregates.confidence_by_pipeline(view(spark, sf_dir, "v_detections"))
    return out.withColumn("confidence_pct", round4("confidence_pct"))


@query(f"""WITH {JUDGED}
SELECT correct, CAST(least(floor(confidence * 25), 24) AS INT) AS bin, count(*) AS images,
       least(floor(confidence * 25), 24) / 25 AS bin_from
FROM judged GROUP BY ALL""")
def confidence_histogram(spark, sf_dir):
    return aggregates.confidence_histogram(judged(spark, sf_dir))


@query(f"""WITH {JUDGED}
SELECT count(*) AS images, round(1e-9 + 100.0 * count(*) FILTER (correct) / count(*), 4)
         AS accuracy_pct,
       round(1e-9 + 100 * avg(confidence), 4) AS confidence_pct,
       count(*) FILTER (localised) AS localised
FROM judged""")
def detection_metrics(spark, sf_dir):
    out = aggregates.detection_metrics(judged(spark, sf_dir))
    return out.withColumns({c: round4(c) for c in ("accuracy_pct", "confidence_pct")})


@query(f"""WITH {JUDGED}
SELECT pipeline, count(*) AS rows,
       round(1e-9 + 100.0 * count(*) FILTER (correct) / count(*), 4) AS accuracy_pct, {_LABEL}
FROM judged GROUP BY pipeline""")
def export_summary(spark, sf_dir):
    out = aggregates.export_summary(judged(spark, sf_dir))
    return out.withColumn("accuracy_pct", round4("accuracy_pct"))


@query(f"""WITH {PLACED}
SELECT camera_id, habitat_type, count(image_id) AS images,
       count(*) FILTER (correct) AS correct, round(1e-9 + avg(confidence), 4) AS mean_confidence,
       round(1e-9 + 100.0 * count(*) FILTER (correct) / count(image_id), 4) AS accuracy_pct
FROM placed GROUP BY camera_id, habitat_type""")
def site_summary(spark, sf_dir):
    out = aggregates.site_summary(filters.geolocated(placed(spark, sf_dir)))
    return out.withColumns({c: round4(c) for c in ("mean_confidence", "accuracy_pct")})


@query(f"""WITH {PLACED}
SELECT image_id, pipeline, latitude, longitude,
  CASE WHEN correct THEN '#2D9E5F' ELSE '#E05C3A' END AS colour,
  concat(camera_id, ' · ', printf('%.0f%%', 100 * confidence)) AS tooltip,
  concat_ws(chr(10), upper(species[1]) || species[2:], concat('Site: ', camera_id),
            concat('Habitat: ', habitat_type),
            concat('Confidence: ', printf('%.1f%%', 100 * confidence)),
            CASE WHEN correct THEN 'Correct' ELSE 'Incorrect' END) AS popup
FROM placed""")
def map_points(spark, sf_dir):
    return filters.map_points(placed(spark, sf_dir))


@query("SELECT image_id, pipeline, confidence FROM v_detections WHERE confidence >= 0.75")
def above_confidence(spark, sf_dir):
    rows = view(spark, sf_dir, "v_detections").select("image_id", "pipeline", "confidence")
    return filters.above_confidence(rows, 0.75)


@query("""SELECT count(*) FILTER (confidence >= 0.75) AS shown, count(*) AS total
FROM v_detections""")
def confidence_caption(spark, sf_dir):
    return filters.confidence_caption(view(spark, sf_dir, "v_detections"), 0.75)


@query(f"""WITH {JUDGED}
SELECT image_id, pipeline, confidence, correct FROM judged WHERE NOT correct""")
def by_verdict(spark, sf_dir):
    rows = judged(spark, sf_dir).select("image_id", "pipeline", "confidence", "correct")
    return filters.by_verdict(rows, False)


@query(f"WITH {JUDGED} SELECT image_id, pipeline, location, localised FROM judged")
def localised(spark, sf_dir):
    return judged(spark, sf_dir).select("image_id", "pipeline", "location", "localised")


@query(f"WITH {PLACED} SELECT image_id, pipeline, latitude, longitude FROM placed")
def geolocated(spark, sf_dir):
    rows = placed(spark, sf_dir).select("image_id", "pipeline", "latitude", "longitude")
    return filters.geolocated(rows)


@query("SELECT image_id, pipeline, confidence FROM v_detections")
def sort_detections(spark, sf_dir):
    rows = view(spark, sf_dir, "v_detections").select("image_id", "pipeline", "confidence")
    return ranking.sort_detections(rows, "confidence_low")


@query("SELECT image_id, site_id, seq FROM v_images WHERE species_label = 'purchase'")
def filter_species(spark, sf_dir):
    images = view(spark, sf_dir, "v_images").select("image_id", "species_label", "site_id", "seq")
    return filters.filter_species(images, "purchase").drop("species_label")


@query("SELECT image_id, species_label FROM v_images ORDER BY seq LIMIT 8")
def preview(spark, sf_dir):
    return ranking.preview(view(spark, sf_dir, "v_images"), 8, "seq").select(
        "image_id", "species_label"
    )


@query("""SELECT image_id, species, printf('%.1f%%', 100 * confidence) AS confidence,
  detection_quality, location_type FROM v_detections""")
def project_available(spark, sf_dir):
    """No verdict column here, so it is left out."""
    return filters.project_available(view(spark, sf_dir, "v_detections"))


@query("""SELECT image_id, species_label, 'none' AS camera_note, habitat_type FROM v_images""")
def with_defaults(spark, sf_dir):
    images = view(spark, sf_dir, "v_images").select("image_id", "species_label", "habitat_type")
    return filters.with_defaults(images, {"camera_note": "none", "habitat_type": "unknown"})
