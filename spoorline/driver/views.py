"""The driver tables seen as camera-trap tables.

Each view is one SQL text that Spark and DuckDB read alike. Views only rename and
compute within a row, so they cost no shuffle.
"""

from pyspark.sql import DataFrame, SparkSession

# Image metadata. Every 25th site has no coordinates.
V_IMAGES = """
SELECT CAST(event_id AS STRING) AS image_id, event_id AS seq,
       concat('images/', CAST(event_id AS STRING), '.jpg') AS local_image_path,
       event_type AS species_label, CAST(ts AS STRING) AS date_captured,
       concat('S', lpad(CAST(user_id AS STRING), 6, '0')) AS site_id,
       CASE WHEN user_id % 25 = 0 THEN CAST(0 AS DOUBLE)
            ELSE CAST(-2.33 AS DOUBLE) + (user_id % 21 - 10) / CAST(100 AS DOUBLE)
       END AS latitude,
       CASE WHEN user_id % 25 = 0 THEN CAST(0 AS DOUBLE)
            ELSE CAST(34.83 AS DOUBLE) + (user_id % 17 - 8) / CAST(100 AS DOUBLE)
       END AS longitude,
       CASE user_id % 3 WHEN 0 THEN 'grassland' WHEN 1 THEN 'woodland' ELSE 'kopje'
       END AS habitat_type
FROM {events}
"""

# Labels in which an even image occurs twice and an odd one never.
V_LABELS = """
SELECT CAST(event_id - event_id % 2 AS STRING) AS image_id, event_id AS seq,
       event_type AS species_label
FROM {events}
"""

# Annotations, two per even image; some counts are missing.
V_ANNOTATIONS = """
SELECT CAST(event_id - event_id % 2 AS STRING) AS image_id, event_id AS seq,
       CASE WHEN k <= 10 THEN CAST(k AS STRING) WHEN k <= 50 THEN '11-50'
            WHEN k <= 95 THEN '51+' ELSE NULL END AS count,
       value / CAST(500 AS DOUBLE) AS standing
FROM (SELECT event_id, value,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
      FROM {events}) e
"""

# Raw boxes of an image in fractions of 1920x1080 and in pixels. The id of a box
# is made of its own row, so that numbering needs no window; the few boxes that
# share one are told apart by their coordinates.
V_BOXES = """
SELECT CAST(l_orderkey AS STRING) AS image_id,
       l_linenumber * CAST(1000000000000 AS BIGINT) + l_partkey AS box_id,
       CAST(l_partkey % 40 AS INT) AS class_id,
       CAST(l_suppkey % 3 + 1 AS STRING) AS category,
       l_discount * CAST(10 AS DOUBLE) AS conf,
       l_tax AS x, l_quantity / CAST(100 AS DOUBLE) AS y,
       CAST(0.25 AS DOUBLE) AS w, CAST(0.5 AS DOUBLE) AS h,
       CAST(floor(l_tax * 1920) AS INT) AS x1,
       CAST(floor(l_quantity / CAST(100 AS DOUBLE) * 1080) AS INT) AS y1,
       CAST(floor((l_tax + CAST(0.25 AS DOUBLE)) * 1920) AS INT) AS x2,
       CAST(floor((l_quantity / CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) * 1080) AS INT)
           AS y2
FROM {lineitem}
"""

# Raw masks; the third line of an order has no confidence.
V_MASKS = """
SELECT CAST(l_orderkey AS STRING) AS image_id,
       l_linenumber * CAST(1000000000000 AS BIGINT) + l_partkey AS mask_id,
       CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount * CAST(10 AS DOUBLE) END AS conf
FROM {lineitem}
"""

# Images that the boxes and masks belong to; some have none.
V_SCENES = """
SELECT CAST(o_orderkey AS STRING) AS image_id FROM {orders}
"""

# Detections of three pipelines on every image, some run for the wrong label.
V_DETECTIONS = """
SELECT CAST(e.event_id AS STRING) AS image_id, e.event_id * 3 + p.pid AS seq, p.pipeline,
       concat('S', lpad(CAST(e.user_id AS STRING), 6, '0')) AS camera_id,
       CAST(e.ts AS STRING) AS timestamp,
       e.event_type AS ground_truth_species,
       CASE (e.event_id * 7 + p.pid) % 6 WHEN 0 THEN 'click' ELSE e.event_type END AS species,
       ((e.event_id * (p.pid + 7)) % 1000) / CAST(1000 AS DOUBLE) AS confidence,
       CAST((e.event_id + p.pid) % 9 AS INT) AS instance_count,
       CASE WHEN p.pid = 0 THEN 'mask' ELSE 'bbox' END AS location_type,
       CASE WHEN (e.event_id + p.pid) % 9 = 0
            THEN CASE p.pid WHEN 0 THEN 'no_mask' ELSE 'no_detection' END
            WHEN p.pid = 0 THEN 'mask_saved' ELSE '1,2,30,40' END AS location,
       CASE WHEN (e.event_id + p.pid) % 9 = 0 THEN CAST(0 AS DOUBLE)
            ELSE ((e.event_id * (p.pid + 3)) % 997) / CAST(997 AS DOUBLE)
       END AS detection_quality,
       concat('images/', CAST(e.event_id AS STRING), '.jpg') AS image_path,
       concat('results/', p.pipeline, '/overlays/', CAST(e.event_id AS STRING),
              '_overlay.jpg') AS overlay_path
FROM {events} e
LATERAL_PIPELINES
"""
_SPARK_PIPELINES = """LATERAL VIEW inline(array(
    named_struct('pid', 0, 'pipeline', 'bioclip_sam'),
    named_struct('pid', 1, 'pipeline', 'bioclip_yolo'),
    named_struct('pid', 2, 'pipeline', 'bioclip_megadetector'))) p AS pid, pipeline"""
_DUCKDB_PIPELINES = """CROSS JOIN (VALUES (0, 'bioclip_sam'), (1, 'bioclip_yolo'),
    (2, 'bioclip_megadetector')) p(pid, pipeline)"""

# Images with vectors; the label is the true species.
V_GALLERY = """
SELECT CAST(vec_id AS STRING) AS image_id, vec_id AS seq,
       concat('images/', CAST(vec_id AS STRING), '.jpg') AS local_image_path,
       CAST(label AS STRING) AS species_label,
       concat('2024-01-', lpad(CAST(vec_id % 28 + 1 AS STRING), 2, '0')) AS date_captured,
       concat('S', lpad(CAST(vec_id % 150 AS STRING), 6, '0')) AS site_id,
       CAST(-2.33 AS DOUBLE) + (vec_id % 21 - 10) / CAST(100 AS DOUBLE) AS latitude,
       CAST(34.83 AS DOUBLE) + (vec_id % 17 - 8) / CAST(100 AS DOUBLE) AS longitude,
       CASE vec_id % 3 WHEN 0 THEN 'grassland' WHEN 1 THEN 'woodland' ELSE 'kopje'
       END AS habitat_type,
       embedding
FROM {embeddings}
"""

# One prompt per label: the vector of its first image.
V_PROMPTS = """
SELECT CAST(label AS STRING) AS species, CAST(label AS INT) AS ord,
       ARG_MIN(embedding, vec_id) AS embedding
FROM {embeddings} GROUP BY label
"""

# Files of an upload. Their bytes are built from the row: PNG, JPEG with and
# without a capture time, GIF and junk, around the smallest accepted size.
V_UPLOADS = """
SELECT concat('upload/', CAST(event_id AS STRING),
              CASE event_type WHEN 'click' THEN '.png' WHEN 'signup' THEN '.gif'
                              ELSE '.jpg' END) AS path,
       event_type AS kind, 600 + event_id % 97 AS width, 440 + user_id % 89 AS height,
       ts
FROM {events}
"""

VIEWS = {
    "v_images": V_IMAGES,
    "v_labels": V_LABELS,
    "v_annotations": V_ANNOTATIONS,
    "v_boxes": V_BOXES,
    "v_masks": V_MASKS,
    "v_scenes": V_SCENES,
    "v_detections": V_DETECTIONS,
    "v_gallery": V_GALLERY,
    "v_prompts": V_PROMPTS,
    "v_uploads": V_UPLOADS,
}
TABLES = ("events", "embeddings", "lineitem", "orders")


def with_views(sql: str) -> str:
    """DuckDB text of a query with the views it names as common table expressions."""
    plain = {t: t for t in TABLES}
    bodies = {
        name: text.format(**plain).replace("LATERAL_PIPELINES", _DUCKDB_PIPELINES)
        for name, text in VIEWS.items()
    }
    used = [f"{name} AS ({body})" for name, body in bodies.items() if name in sql]
    if not used:
        return sql
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(used) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(used) + "\n" + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    text = VIEWS[name].replace("LATERAL_PIPELINES", _SPARK_PIPELINES)
    text = text.replace("ARG_MIN", "min_by")
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
