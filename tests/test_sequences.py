"""Sequences against a walk over each camera's detections."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from spoorline.operators.sequences import camera_sequences, sequence_summary

START = datetime(2020, 1, 1, tzinfo=timezone.utc)


def walk(rows, gap):
    """rows: (image_id, camera, seconds or None). (image_id, sequence, position, length, gap, duration)."""
    out, cameras = [], {}
    for image_id, camera, at in rows:
        if camera is None or at is None:
            out.append((image_id, None, None, None, None, None))
        else:
            cameras.setdefault(camera, []).append((at, image_id))
    for camera, seen in cameras.items():
        seen.sort()
        runs, last = [], None
        for at, image_id in seen:
            if last is None or at - last > gap:
                runs.append([])
            runs[-1].append((at, image_id, None if last is None else at - last))
            last = at
        for run in runs:
            name = f"{camera}@{round((START.timestamp() + run[0][0]) * 1_000_000)}"
            for k, (_, image_id, before) in enumerate(run, 1):
                out.append((image_id, name, k, len(run), before, float(run[-1][0] - run[0][0])))
    return sorted(out, key=repr)


def frame(spark, rows):
    def text(at):
        return None if at is None else (START + timedelta(seconds=at)).strftime("%Y-%m-%d %H:%M:%S")

    return spark.createDataFrame(
        [(i, c, text(t)) for i, c, t in rows], "image_id string, camera_id string, timestamp string"
    )


COLUMNS = ["image_id", "sequence_id", "position", "sequence_length", "gap_seconds", "sequence_seconds"]


@pytest.mark.parametrize("pieces", [1, 4, 23])
def test_a_camera_with_most_rows_is_cut_and_joined_again(spark, rows, pieces):
    rng = random.Random(pieces)
    data = [(f"h{k:05d}", "hot", rng.choice([k // 3 * 5, k * 40, 100_000 + k * 1000])) for k in range(2500)]
    data += [(f"s{k}", f"c{k % 60}", rng.randrange(5000)) for k in range(900)]
    data += [("long1", "one", 7 * k) for k in range(1)] + [(f"l{k:04d}", "long", 30 * k) for k in range(800)]
    data += [("n1", None, 5), ("n2", "hot", None), ("n3", None, None)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = rows(camera_sequences(frame(spark, data), 60), *COLUMNS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == walk(data, 60)


def test_odd_rows(spark, rows):
    data = [("a", "x", 0), ("a", "x", 0), ("b", "x", 60), ("c", "x", 121)]
    found = camera_sequences(frame(spark, data), 60)
    assert rows(found, *COLUMNS) == walk(data, 60)
    unreadable = frame(spark, data[:1]).withColumn("timestamp", F.lit("yesterday"))
    assert rows(camera_sequences(unreadable), "image_id", "sequence_id") == [("a", None)]
    assert camera_sequences(frame(spark, data).limit(0)).count() == 0


def test_other_columns_stay_and_old_results_go(spark):
    names = ("row", "camera", "at", "next", "piece", "start", "n", "place", "a.b")
    given = frame(spark, [("a", "x", 0), ("b", "x", 5)]).withColumns({c: F.lit(c) for c in names})
    once = camera_sequences(given)
    assert once.columns == [*given.columns, *COLUMNS[1:]]
    again = camera_sequences(once)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))
    assert {tuple(r) for r in again.select(*[f"`{c}`" for c in names]).collect()} == {names}


def test_windows_over_rows_stay_within_pieces(spark, plan):
    found = camera_sequences(frame(spark, [("a", "x", 0)]))
    assert "hashpartitioning(camera" in plan(found) and "SinglePartition" not in plan(found)


def test_summary(spark, rows):
    data = frame(spark, [("a", "x", 0), ("b", "x", 50), ("c", "x", 90), ("d", "x", 500)])
    done = camera_sequences(data.withColumn("species", F.when(F.col("image_id") == "b", "lion").otherwise("hyena")), 60)
    found = rows(sequence_summary(done), "detections", "species", "sequence_seconds", "longest_gap_seconds")
    assert found == [(1, 1, 0.0, None), (3, 2, 90.0, 50.0)]
