"""Queries on sequences of detections."""

from spoorline.driver.registry import query
from spoorline.driver.views import view
from spoorline.operators import sequences

#: Seconds without a detection that end a sequence here; the test cameras record rarely.
GAP = 6 * 3600

SEQUENCES = f"""
timed AS (
  SELECT image_id, pipeline, species, camera_id,
         epoch_us(CAST(timestamp AS TIMESTAMP)) AS micros FROM v_detections),
gaps AS (
  SELECT *, micros - lag(micros) OVER (PARTITION BY camera_id ORDER BY micros, image_id, pipeline) AS gap
  FROM timed),
numbered AS (
  SELECT *, sum(CASE WHEN gap <= {GAP}000000 THEN 0 ELSE 1 END)
              OVER (PARTITION BY camera_id ORDER BY micros, image_id, pipeline ROWS UNBOUNDED PRECEDING)
              AS number
  FROM gaps),
sequences AS (
  SELECT image_id, pipeline, species, camera_id,
         concat(camera_id, '@', CAST(min(micros) OVER s AS VARCHAR)) AS sequence_id,
         row_number() OVER (PARTITION BY camera_id, number ORDER BY micros, image_id, pipeline)
           AS position,
         count(*) OVER s AS sequence_length, gap / 1000000 AS gap_seconds,
         (max(micros) OVER s - min(micros) OVER s) / 1000000 AS sequence_seconds
  FROM numbered WINDOW s AS (PARTITION BY camera_id, number))
"""


def _sequences(spark, sf_dir):
    rows = view(spark, sf_dir, "v_detections")
    rows = rows.select("image_id", "pipeline", "species", "camera_id", "timestamp")
    return sequences.camera_sequences(rows, GAP, order=("image_id", "pipeline")).drop("timestamp")


@query(f"WITH {SEQUENCES} SELECT * FROM sequences")
def camera_sequences(spark, sf_dir):
    """Every detection with its camera's sequence."""
    return _sequences(spark, sf_dir)


@query(f"""WITH {SEQUENCES}
SELECT camera_id, sequence_id, count(*) AS detections, count(DISTINCT species) AS species,
       max(sequence_seconds) AS sequence_seconds,
       max(CASE WHEN position > 1 THEN gap_seconds END) AS longest_gap_seconds
FROM sequences GROUP BY camera_id, sequence_id""")
def sequence_summary(spark, sf_dir):
    return sequences.sequence_summary(_sequences(spark, sf_dir))
