import pytest
from pyspark.sql import functions as F

from spoorline import schemas
from spoorline.operators import filters, sets


@pytest.fixture
def images(spark):
    return spark.createDataFrame(
        [("1", "zebra"), ("2", "zebra"), ("3", "lioncub")], "image_id string, species_label string")


def test_target_species(images):
    def names(requested):
        return [r.species for r in filters.target_species(images, requested).collect()]

    assert names(["lioncub", "yeti", "zebra"]) == ["lioncub", "zebra"]
    assert names(None) == ["zebra", "lioncub"]
    assert names([]) == ["zebra", "lioncub"]
    assert names(["yeti"]) == []


def test_species_and_pipeline_dimensions(spark):
    dim = filters.species_dim(spark).collect()
    assert len(dim) == 13 and [r.ord for r in dim] == list(range(13))
    assert [r.pipeline for r in filters.pipeline_dim(spark).orderBy("ord").collect()] == [
        "bioclip_sam", "bioclip_yolo", "bioclip_megadetector"]


def test_paths(spark, rows):
    files = spark.createDataFrame(
        [(p,) for p in ["/abs/one.jpg", "/root/img/two.jpg", "/dir1/three.jpg", "/dir2/three.jpg",
                        "/dir2/four.jpg", "/elsewhere/five.jpg", "/dir1/deep/six.jpg"]],
        "path string")
    images = spark.createDataFrame(
        [("/abs/one.jpg",), ("img/two.jpg",), ("old/three.jpg",), ("/gone/four.jpg",),
         ("five.jpg",), ("six.jpg",)], "local_image_path string")
    out = filters.resolve_paths(images, files, "/root", ["/dir1", "/dir2"])
    assert rows(out) == sorted(
        [("/abs/one.jpg",), ("/root/img/two.jpg",), ("/dir1/three.jpg",), ("/dir2/four.jpg",),
         ("five.jpg",), ("six.jpg",)], key=repr)
    assert filters.keep_existing(out, files).count() == 4
    counts = filters.existing_counts(out, files).first()
    assert (counts["images"], counts.found, counts.missing) == (6, 4, 2)


def test_confidence(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.49,), (1.0,), (None,)], "confidence double")
    assert filters.above_confidence(df, 0.5).count() == 2
    caption = filters.confidence_caption(df, 0.5).first()
    assert (caption.shown, caption.total) == (2, 5)


def test_by_verdict(spark):
    df = spark.createDataFrame(
        [("a", 0.2, True), ("b", 0.9, True), ("c", 0.5, False)],
        "image_id string, confidence double, correct boolean")
    assert [r.image_id for r in filters.by_verdict(df, True).collect()] == ["b", "a"]
    assert [r.image_id for r in filters.by_verdict(df, False).collect()] == ["c"]


def test_geolocated(spark, rows):
    df = spark.createDataFrame(
        [("a", 0.0, 0.0), ("b", 0.0, 3.0), ("c", None, 3.0), ("d", 1.0, 1.0)],
        "image_id string, latitude double, longitude double")
    assert rows(filters.geolocated(df), "image_id") == [("b",), ("d",)]


def test_localised_without_the_column(images, rows):
    assert rows(filters.localised(images), "localised") == [(False,)] * 3


def test_overlays(spark, rows):
    overlays = spark.createDataFrame(
        [("/o/a_overlay.jpg",), ("/o/b_overlay.jpg",)], "path string")

    def chosen(paths):
        detections = spark.createDataFrame([(p,) for p in paths], "image_path string")
        return [r.path for r in filters.overlays_for_species(overlays, detections).collect()]

    assert chosen(["x/b.jpg", None]) == ["/o/b_overlay.jpg"]
    assert chosen(["x/nothing.jpg"]) == ["/o/a_overlay.jpg", "/o/b_overlay.jpg"]
    assert chosen([]) == ["/o/a_overlay.jpg", "/o/b_overlay.jpg"]


def test_projection_and_guards(spark, images):
    df = spark.createDataFrame(
        [("a", 0.1234, True)], "image_id string, confidence double, correct boolean")
    out = filters.project_available(df)
    assert out.columns == ["image_id", "confidence", "correct"]
    assert out.first().confidence == "12.3%"
    assert filters.has_columns(df, ["correct"]) and not filters.has_columns(df, ["species"])
    with pytest.raises(ValueError, match="species"):
        filters.require_columns(df, ["image_id", "species"])
    filled = filters.with_defaults(df.withColumn("correct", F.lit(None)), {"correct": 1, "x": "y"})
    assert filled.first().correct is None and filled.first().x == "y"
    assert filters.filter_species(images, "zebra").count() == 2


def test_detection_records(spark):
    located = spark.createDataFrame(
        [("a", "img/a.b.jpg", "S1", 0.123456, "mask", "mask_saved", 0.98765, 2, "zebra", "correct"),
         ("c", "img/c.jpg", "S1", 1.0, "mask", "no_mask", 0.0, 0, "unknown", "unknown")],
        "image_id string, local_image_path string, site_id string, confidence double, "
        "location_type string, location string, detection_quality double, instance_count int, "
        "ground_truth_species string, correct string")
    out = filters.to_detection_records(located, "bioclip_sam", "zebra", "out")
    assert out.columns == schemas.DETECTIONS.fieldNames()
    got = {r.image_id: r for r in out.collect()}
    assert got["a"].confidence == 0.1235 and got["a"].detection_quality == 0.9877
    assert got["a"].mask_path == "out/bioclip_sam/masks/a.b_mask.png"
    assert got["c"].mask_path == "" and got["c"].latitude == 0.0 and got["c"].timestamp == ""
    assert got["a"].overlay_path == "out/bioclip_sam/overlays/a.b_overlay.jpg"
    assert len(got["a"].detection_id) == 16 and got["a"].detection_id != got["c"].detection_id
    unnamed = filters.to_detection_records(located.drop("image_id"), "p", "zebra")
    assert {r.image_id for r in unnamed.collect()} == {"a.b", "c"}


def test_map_points(spark):
    df = spark.createDataFrame(
        [("a", "p", "lioncub", 0.045, True, 1.0, 2.0, "S1"),
         ("b", "p", "zebra", 0.5, None, 0.0, 0.0, "S1")],
        "image_id string, pipeline string, species string, confidence double, correct boolean, "
        "latitude double, longitude double, camera_id string")
    (point,) = filters.map_points(df).collect()
    assert point.tooltip == "S1 · 4%" and point.colour == "#2D9E5F"
    assert point.popup.split("\n") == [
        "Lion (cub)", "Site: S1", "Habitat: ?", "Confidence: 4.5%", "Correct"]


def test_unions(spark, images, rows):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y",)], "s string")
    assert rows(sets.union_pipelines([a, None, b]), "n", "s") == sorted([(1, "x"), (None, "y")],
                                                                       key=repr)
    with pytest.raises(ValueError):
        sets.union_pipelines([None])
    some = sets.concat_species(images.withColumn("seq", F.col("image_id")), ["zebra"], 1)
    assert rows(some, "image_id") == [("1",)]
