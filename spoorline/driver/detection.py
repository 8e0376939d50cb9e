"""Queries on detector output."""

from pyspark.sql import functions as F

from spoorline.driver.registry import query, round4
from spoorline.driver.views import view
from spoorline.operators import detectors, filters, joins, models

ANIMAL = "class_id BETWEEN 16 AND 25"
KEPT = f"({ANIMAL} AND conf >= 0.2)"
BOX = "image_id, box_id, class_id, conf, x1, y1, x2, y2"
_ORDER = "conf DESC, box_id, class_id, x1, y1, x2, y2"


def boxes(spark, sf_dir):
    return view(spark, sf_dir, "v_boxes").select(*BOX.split(", "))


ANIMAL_BOXES = f"""
animal_boxes AS (
  SELECT {BOX} FROM (
    SELECT *, bool_or({KEPT}) OVER (PARTITION BY image_id) AS any_kept,
           row_number() OVER (PARTITION BY image_id ORDER BY {_ORDER}) AS rn
    FROM v_boxes)
  WHERE {KEPT} OR (NOT any_kept AND rn = 1))
"""


@query(f"WITH {ANIMAL_BOXES} SELECT * FROM animal_boxes")
def animal_boxes(spark, sf_dir):
    return detectors.animal_boxes(boxes(spark, sf_dir))


@query(f"""SELECT {BOX} FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id
    ORDER BY CASE WHEN {ANIMAL} THEN 0 ELSE 1 END, {_ORDER}) AS rn FROM v_boxes)
WHERE rn = 1""")
def best_animal_box(spark, sf_dir):
    return detectors.best_animal_box(boxes(spark, sf_dir))


@query(f"""SELECT {BOX} FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_ORDER}) AS rn FROM v_boxes)
WHERE rn = 1""")
def best_box(spark, sf_dir):
    return detectors.best_box(boxes(spark, sf_dir))


CATEGORY_BOXES = """
category_boxes AS (
  SELECT image_id, box_id, category, conf,
         CAST(trunc(x * 1920) AS INT) AS x1, CAST(trunc(y * 1080) AS INT) AS y1,
         CAST(trunc((x + w) * 1920) AS INT) AS x2, CAST(trunc((y + h) * 1080) AS INT) AS y2
  FROM v_boxes WHERE category = '1' AND conf >= 0.2)
"""


def fraction_boxes(spark, sf_dir):
    return view(spark, sf_dir, "v_boxes").select(
        "image_id", "box_id", "category", "conf", "x", "y", "w", "h"
    )


@query(f"WITH {CATEGORY_BOXES} SELECT * FROM category_boxes")
def category_boxes(spark, sf_dir):
    return detectors.category_boxes(fraction_boxes(spark, sf_dir), 1920, 1080)


@query(f"SELECT {BOX} FROM v_boxes WHERE {KEPT}")
def class_boxes(spark, sf_dir):
    return detectors.class_boxes(boxes(spark, sf_dir))


LOCALISED_BOXES = f"""
{ANIMAL_BOXES},
localised_boxes AS (
  SELECT s.image_id, 'bbox' AS location_type,
         CASE WHEN b.n IS NULL THEN 'no_detection'
              ELSE concat_ws(',', b.x1, b.y1, b.x2, b.y2) END AS location,
         coalesce(b.conf, CAST(0 AS DOUBLE)) AS detection_quality,
         CAST(coalesce(b.n, 0) AS INT) AS instance_count
  FROM v_scenes s LEFT JOIN (
    SELECT * FROM (
      SELECT *, count(*) OVER (PARTITION BY image_id) AS n,
             row_number() OVER (PARTITION BY image_id ORDER BY {_ORDER}) AS rn
      FROM animal_boxes) WHERE rn = 1) b ON s.image_id = b.image_id)
"""


@query(f"WITH {LOCALISED_BOXES} SELECT * FROM localised_boxes")
def localise_boxes(spark, sf_dir):
    """Keeping animal boxes and summing them up in one aggregate."""
    return detectors.localise_animals(view(spark, sf_dir, "v_scenes"), boxes(spark, sf_dir))


@query(f"WITH {LOCALISED_BOXES} SELECT * FROM localised_boxes")
def localise_boxes_in_steps(spark, sf_dir):
    """The same as two operators, one after the other."""
    kept = detectors.animal_boxes(boxes(spark, sf_dir))
    return detectors.localise(view(spark, sf_dir, "v_scenes"), kept, "bbox")


@query(f"""WITH {CATEGORY_BOXES}
SELECT s.image_id, 'bbox' AS location_type,
       CASE WHEN b.n IS NULL THEN 'no_detection'
            ELSE concat_ws(',', b.x1, b.y1, b.x2, b.y2) END AS location,
       coalesce(b.conf, CAST(0 AS DOUBLE)) AS detection_quality,
       CAST(coalesce(b.n, 0) AS INT) AS instance_count
FROM v_scenes s LEFT JOIN (
  SELECT * FROM (
    SELECT *, count(*) OVER (PARTITION BY image_id) AS n,
           row_number() OVER (PARTITION BY image_id
                              ORDER BY conf DESC, box_id, category, x1, y1, x2, y2) AS rn
    FROM category_boxes) WHERE rn = 1) b ON s.image_id = b.image_id""")
def localise_counted_boxes(spark, sf_dir):
    raw = fraction_boxes(spark, sf_dir).withColumns(
        {"width": F.lit(1920), "height": F.lit(1080)}
    )
    return models.pipeline("bioclip_megadetector").localise(view(spark, sf_dir, "v_scenes"), raw)


@query("""SELECT s.image_id, 'mask' AS location_type,
       CASE WHEN m.n IS NULL THEN 'no_mask' ELSE 'mask_saved' END AS location,
       coalesce(m.quality, CAST(0 AS DOUBLE)) AS detection_quality,
       CAST(coalesce(m.n, 0) AS INT) AS instance_count
FROM v_scenes s LEFT JOIN (
  SELECT image_id, count(*) AS n, max(coalesce(conf, CAST(1 AS DOUBLE))) AS quality
  FROM v_masks GROUP BY image_id) m ON s.image_id = m.image_id""")
def localise_masks(spark, sf_dir):
    return models.pipeline("bioclip_sam").localise(
        view(spark, sf_dir, "v_scenes"), view(spark, sf_dir, "v_masks")
    )


@query(f"""SELECT s.image_id, CAST(count(b.image_id) AS INT) AS instance_count
FROM v_scenes s LEFT JOIN (SELECT * FROM v_boxes WHERE {KEPT}) b ON s.image_id = b.image_id
GROUP BY s.image_id""")
def instance_counts(spark, sf_dir):
    kept = detectors.class_boxes(boxes(spark, sf_dir))
    return detectors.instance_counts(view(spark, sf_dir, "v_scenes"), kept)


@query("SELECT image_id, mask_id, coalesce(conf, CAST(1 AS DOUBLE)) AS conf FROM v_masks")
def mask_instances(spark, sf_dir):
    return detectors.mask_instances(view(spark, sf_dir, "v_masks"))


@query("""SELECT s.image_id, m.mask_id, m.conf,
       CAST(CASE WHEN m.mask_id IS NULL THEN 0 ELSE 1 END AS INT) AS instance_count
FROM v_scenes s LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id
                   ORDER BY conf DESC NULLS LAST, mask_id) AS rn FROM v_masks)
  WHERE rn = 1) m ON s.image_id = m.image_id""")
def single_mask(spark, sf_dir):
    return detectors.single_mask(view(spark, sf_dir, "v_scenes"), view(spark, sf_dir, "v_masks"))


@query("""SELECT image_id, pipeline,
  CASE WHEN location = '1,2,30,40' THEN 1 END AS x1,
  CASE WHEN location = '1,2,30,40' THEN 2 END AS y1,
  CASE WHEN location = '1,2,30,40' THEN 30 END AS x2,
  CASE WHEN location = '1,2,30,40' THEN 40 END AS y2
FROM v_detections""")
def decoded_boxes(spark, sf_dir):
    rows = view(spark, sf_dir, "v_detections").select("image_id", "pipeline", "location")
    return filters.decoded_boxes(rows).drop("location")


RECORDS = f"""
{LOCALISED_BOXES},
records AS (
  SELECT substr(sha256(concat_ws('|', 'bioclip_yolo', 'view', i.image_id)), 1, 16)
           AS detection_id,
         i.image_id, 'bioclip_yolo' AS pipeline, i.date_captured AS timestamp,
         i.site_id AS camera_id, i.latitude, i.longitude, i.habitat_type,
         'view' AS species, CAST(1 AS DOUBLE) AS confidence,
         coalesce(l.location_type, 'bbox') AS location_type,
         coalesce(l.location, 'no_detection') AS location,
         round(1e-9 + coalesce(l.detection_quality, 0), 4) AS detection_quality,
         coalesce(l.instance_count, 0) AS instance_count,
         i.local_image_path AS image_path, '' AS mask_path,
         concat('results/bioclip_yolo/overlays/', i.image_id, '_overlay.jpg') AS overlay_path,
         i.species_label AS ground_truth_species,
         CASE WHEN i.species_label = 'view' THEN 'correct' ELSE 'incorrect' END AS correct
  FROM v_images i LEFT JOIN (
    SELECT b.* FROM localised_boxes b WHERE b.location <> 'no_detection') l
    ON i.image_id = l.image_id)
"""


@query(f"WITH {RECORDS} SELECT * FROM records")
def detection_records(spark, sf_dir):
    images = view(spark, sf_dir, "v_images")
    located = models.pipeline("bioclip_yolo").localise(
        images.withColumn("species", F.lit("view")), boxes(spark, sf_dir)
    )
    judged = joins.with_ground_truth(located, images.select("image_id", "species_label", "seq"))
    return filters.to_detection_records(judged, "bioclip_yolo", "view")


def _with_gaps(spark, sf_dir):
    """The gallery, where every 7th image has no content and every 11th cannot be read."""
    broken = F.array_repeat(F.lit(-1.0).cast("float"), 64)
    vector = F.when(F.col("seq") % 11 == 0, broken).otherwise(F.col("embedding"))
    return view(spark, sf_dir, "v_gallery").select(
        "image_id", F.when(F.col("seq") % 7 != 0, vector).alias("embedding")
    )


@query("""SELECT image_id,
  CASE WHEN seq % 7 <> 0 AND seq % 11 <> 0 THEN CAST(e[1] * 2 AS DOUBLE) END AS first,
  CASE WHEN seq % 7 <> 0 AND seq % 11 <> 0 THEN CAST(e[64] * 2 AS DOUBLE) END AS last
FROM (SELECT image_id, seq, embedding AS e FROM v_gallery)""")
def predict_embed(spark, sf_dir):
    """A user's encoder, here one that doubles a vector."""

    def make():
        def encode(vectors):
            if (vectors < -0.99).all(axis=1).any():
                raise models.UnreadableImage
            return vectors * 2

        return encode

    images = _with_gaps(spark, sf_dir)
    out = models.embed_or_fail(images, make, "embedding", width=64)
    return out.select(
        "image_id",
        F.get("embedding", F.lit(0)).cast("double").alias("first"),
        F.get("embedding", F.lit(63)).cast("double").alias("last"),
    )


@query("""SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY i) - 1 AS INT)
           AS box_id, CAST(i - 1 AS INT) AS class_id, round(1e-9 + v, 4) AS conf, backend
FROM (SELECT image_id, unnest(range(1, 65)) AS i,
             CAST(unnest(embedding) AS DOUBLE) AS v, 'second' AS backend FROM v_gallery)
WHERE v > 0.2 AND CAST(image_id AS BIGINT) % 7 <> 0 AND CAST(image_id AS BIGINT) % 11 <> 0""")
def predict_boxes(spark, sf_dir):
    """A user's detector whose first backend does not load."""

    def absent():
        raise ImportError("no such detector")

    def present():
        def find(vector):
            if all(v < -0.99 for v in vector):
                raise models.UnreadableImage
            return [(i, float(v), 0, 0, 1, 1) for i, v in enumerate(vector) if float(v) > 0.2]

        return lambda vectors: [find(v) for v in vectors]

    make = models.agreed(spark, ("first", absent), ("second", present))
    out = models.detect_or_fail(_with_gaps(spark, sf_dir), make, "embedding")
    return out.select("image_id", "box_id", "class_id", round4("conf").alias("conf"), "backend")
