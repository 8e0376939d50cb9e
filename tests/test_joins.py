import pytest
from pyspark.sql import functions as F

from spoorline.operators import aggregates, joins


@pytest.fixture
def detections(spark):
    return spark.createDataFrame(
        [
            ("i1", "p", "zebra", 3, "mask_saved"),
            ("i2", "p", "zebra", 2, "no_mask"),
            ("i3", "p", "zebra", 1, None),
            ("i4", "q", "zebra", 5, ""),
        ],
        "image_id string, pipeline string, species string, instance_count int, location string",
    )


@pytest.fixture
def truth(spark):
    """i1 changes its label, i2 has another one, i3 none; a null id is ignored."""
    return spark.createDataFrame(
        [("i1", "lion", 1), ("i1", "zebra", 9), ("i2", "lion", 2), ("i4", "zebra", 3),
         ("i4", "buffalo", 4), (None, "zebra", 5)],
        "image_id string, species_label string, seq int",
    )


def test_with_ground_truth(detections, truth, rows):
    out = joins.with_ground_truth(detections, truth)
    assert rows(out, "image_id", "ground_truth_species", "correct") == [
        ("i1", "zebra", "correct"),
        ("i2", "lion", "incorrect"),
        ("i3", "unknown", "unknown"),
        ("i4", "buffalo", "incorrect"),
    ]


def test_derive_correct_from_labels(detections, truth, rows):
    out = joins.derive_correct(detections, truth)
    assert rows(out, "image_id", "correct", "localised") == [
        ("i1", True, True),
        ("i2", False, False),
        ("i3", False, False),
        ("i4", False, False),
    ]
    with pytest.raises(ValueError, match="ground truth"):
        joins.derive_correct(detections)


def test_derive_correct_from_text(spark, rows):
    stored = spark.createDataFrame(
        [("a", "Correct"), ("b", "incorrect"), ("c", "unknown"), ("d", None)],
        "image_id string, correct string",
    )
    out = joins.derive_correct(stored)
    assert rows(out, "image_id", "correct", "localised") == [
        ("a", True, False), ("b", False, False), ("c", False, False), ("d", False, False)]


def test_enrichment(spark, rows):
    images = spark.createDataFrame([(i, "x") for i in "abcde"], "image_id string, site_id string")
    annotations = spark.createDataFrame(
        [
            (0, "a", "3", 0.5, 0.1),
            (1, "a", "11-50", 0.25, None),
            (2, "b", None, None, None),
            (3, "c", "12", 1.0, 1.0),
            (4, None, "9", 1.0, 1.0),
            (5, "", "9", 1.0, 1.0),
            (6, "e", "51+", 0.0, 0.0),
        ],
        "pos long, image_id string, count string, standing double, young_present double",
    )
    out = joins.enrich_ground_truth(images, annotations)
    columns = ["image_id", "ground_truth_count", "ground_truth_count_num", "gt_standing",
               "gt_young_present", "gt_resting"]
    assert rows(out, *columns) == [
        ("a", "11-50", 15, 0.25, 0.0, 0.0),
        ("b", "1", 1, 0.0, 0.0, 0.0),
        ("c", "12", 1, 1.0, 1.0, 0.0),
        ("d", None, None, None, None, None),
        ("e", "51+", 51, 0.0, 0.0, 0.0),
    ]
    rate = aggregates.match_rate(out).first()
    assert (rate.matched, rate.total, rate.match_pct) == (4, 5, 80.0)
    # Enriching again replaces the columns instead of repeating them.
    again = joins.enrich_ground_truth(out, annotations)
    assert sorted(again.columns) == sorted(out.columns)
    assert rows(again, *columns) == rows(out, *columns)


@pytest.fixture
def counts(spark):
    return spark.createDataFrame(
        [("i1", 3, "3"), ("i2", None, None), ("i4", 1, "1"), ("i4", 5, "5")],
        "image_id string, gt_count int, ground_truth_count string",
    )


def test_count_errors(detections, counts, rows):
    out = joins.count_errors(detections, counts)
    assert rows(out, "image_id", "count_error", "exact_match") == sorted(
        [("i1", 0.0, True), ("i2", None, False), ("i3", None, False), ("i4", 4.0, False),
         ("i4", 0.0, True)], key=repr)
    last = joins.count_errors(
        detections, counts.withColumn("seq", F.col("gt_count")), dedupe=True, seq="seq"
    )
    assert last.filter("image_id = 'i4'").count() == 1
    with pytest.raises(ValueError, match="orders"):
        joins.count_errors(detections, counts, dedupe=True)


def test_count_accuracy_skips_missing_truth_in_error_only(detections, counts):
    errors = joins.count_errors(detections, counts)
    got = {r.pipeline: r for r in aggregates.count_accuracy(errors).collect()}
    assert got["p"].mae == 0.0 and got["p"].mean_gt == 3.0
    assert got["p"].exact_pct == pytest.approx(100 / 3)
    assert got["q"].mae == 2.0 and got["q"].exact_pct == 50.0


def test_count_accuracy_without_the_join(spark, rows):
    """A hot image repeated on both sides gives the same means either way."""
    left = [("hot", "p", n % 4) for n in range(60)] + [("b", "p", 2), ("c", "q", None)]
    right = [("hot", n % 3 if n % 5 else None) for n in range(40)] + [("b", 2)]
    detections = spark.createDataFrame(
        left, "image_id string, pipeline string, instance_count int")
    truth = spark.createDataFrame(right, "image_id string, gt_count int").withColumn(
        "ground_truth_count", F.lit(""))
    plain = aggregates.count_accuracy(joins.count_errors(detections, truth))
    weighted = aggregates.count_accuracy_from(detections, truth)
    columns = ["mean_count", "mean_gt", "mae", "exact_pct"]
    for a, b in zip(rows(plain, "pipeline", *columns), rows(weighted, "pipeline", *columns)):
        assert a[0] == b[0]
        assert [None if x is None else round(x, 9) for x in a[1:]] == [
            None if x is None else round(x, 9) for x in b[1:]]


def test_combining_models(spark, rows):
    identified = spark.createDataFrame(
        [("a", False, 1), ("a", True, 2), ("b", True, 3), ("c", False, 4), ("d", True, 5)],
        "image_id string, bioclip_correct boolean, seq int")
    located = spark.createDataFrame(
        [("a", False, 0.0, "x", 1), ("a", True, 0.9, "x", 2), ("b", False, 0.0, "x", 3),
         ("c", True, 0.5, "x", 4)],
        "image_id string, megadetector_localised boolean, megadetector_quality double, "
        "megadetector_backend string, seq int")
    out = joins.combine_identification_localisation(identified, located, "seq")
    assert rows(out, "image_id", "megadetector_localised", "megadetector_quality",
                "megadetector_backend", "combined_correct") == [
        ("a", True, 0.9, "x", True),
        ("b", False, 0.0, "x", False),
        ("c", True, 0.5, "x", False),
        ("d", False, 0.0, "unknown", False),
    ]


def test_overlays_by_image(spark, rows):
    detections = spark.createDataFrame(
        [
            ("x/a.jpg", "bioclip_sam", "s2", 2),
            ("x/a.jpg", "bioclip_sam", "s1", 1),
            ("x/a.jpg", "bioclip_yolo", "y", 3),
            ("x/b.jpg", "bioclip_yolo", "only", 4),
        ],
        "image_path string, pipeline string, overlay_path string, seq int")
    out = joins.overlays_by_image(detections)
    assert rows(out, "image_path", "bioclip_sam", "bioclip_yolo", "bioclip_megadetector",
                "compare_name") == [("x/a.jpg", "s1", "y", None, "a_compare.jpg")]
