import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorline.operators import aggregates, reports


@pytest.fixture
def evaluation(spark):
    rows = (
        [("zebra", "zebra", True)] * 3
        + [("zebra", "lioncub", False)] * 13
        + [("lioncub", "lioncub", True)] * 2
        + [("lioncub", "zebra", False)] * 2
        + [("buffalo", "zebra", False)] * 2
    )
    return spark.createDataFrame(
        rows, "true_species string, predicted_species string, correct boolean")


def test_accuracy(evaluation):
    total = aggregates.top1_accuracy(evaluation).first()
    assert (total.total, total.correct) == (22, 5)
    assert total.accuracy_pct == pytest.approx(500 / 22)
    empty = aggregates.top1_accuracy(evaluation.limit(0)).first()
    assert (empty.total, empty.correct, empty.accuracy_pct) == (0, 0, 0.0)


def test_accuracy_per_species(evaluation):
    got = [tuple(r) for r in aggregates.per_species_accuracy(evaluation).collect()]
    assert got == [
        ("lioncub", "Lion (cub)", 4, 2, 50.0, True),
        ("zebra", "Zebra", 16, 3, 18.8, False),
        ("buffalo", "Buffalo", 2, 0, 0.0, False),
    ]
    no_column = aggregates.per_species_accuracy(evaluation.drop("correct"))
    assert {r.correct for r in no_column.collect()} == {0}


def test_confusions_and_their_sum(evaluation, plan):
    got = [tuple(r) for r in aggregates.confusions(evaluation).collect()]
    assert got == [("zebra", "lioncub", 13), ("buffalo", "zebra", 2), ("lioncub", "zebra", 2)]
    assert len(aggregates.confusions(evaluation, 2).collect()) == 2
    total = aggregates.top1_accuracy(evaluation).first()
    assert sum(r[2] for r in got) + total.correct == total.total
    assert "TakeOrderedAndProject" in plan(aggregates.confusions(evaluation))


@pytest.fixture
def detections(spark):
    rows = [
        ("bioclip_sam", "i1", "mask_saved", 0.5, 0.25, True),
        ("bioclip_sam", "i2", "no_mask", 0.25, 0.0, False),
        ("bioclip_sam", "i3", None, 0.75, None, False),
        ("bioclip_yolo", "i1", "1,2,3,4", 1.0, 1.0, True),
    ]
    return spark.createDataFrame(
        rows,
        "pipeline string, image_id string, location string, confidence double, "
        "detection_quality double, correct boolean")


@pytest.fixture
def runs(spark):
    return spark.createDataFrame(
        [("bioclip_sam", 6.0), ("bioclip_megadetector", 9.0)], "pipeline string, elapsed_s double")


def test_comparison_includes_pipelines_without_rows(detections, runs):
    got = {r.pipeline: r for r in aggregates.pipeline_comparison(detections, runs).collect()}
    sam = got["bioclip_sam"]
    assert (sam.processed, sam.localised, sam.mean_confidence, sam.mean_quality) == (
        3, 1, 0.5, 0.125)
    assert sam.seconds_per_image == 2.0
    absent = got["bioclip_megadetector"]
    assert (absent.processed, absent.localised, absent.mean_confidence) == (0, 0, None)
    assert absent.seconds_per_image == 9.0
    assert got["bioclip_yolo"].elapsed_s == 0.0
    cards = {r.pipeline: r for r in aggregates.pipeline_cards(detections).collect()}
    assert set(cards) == {"bioclip_sam", "bioclip_yolo"}
    assert cards["bioclip_sam"].pipeline_output == "Multi-instance pixel masks"


def test_comparison_page(detections, runs):
    metrics = aggregates.pipeline_comparison(detections, runs)
    page = [r.text for r in reports.in_order(reports.comparison_report(metrics, "zebra")).collect()]
    assert page[1] == "Pipeline 1 Comparison Report  |  Species: zebra"
    assert page[4] == f"{'Metric':<28} {'BioCLIP+SAM':>13} {'BioCLIP+YOLO':>14} {'SAM 3':>8}"
    assert page[6:12] == [
        f"{'Images processed':<28} {'3':>13} {'1':>14} {'0':>8}",
        f"{'Successful detections':<28} {'1':>13} {'1':>14} {'0':>8}",
        f"{'Avg confidence':<28} {'50.0%':>13} {'100.0%':>14} {'n/a':>8}",
        f"{'Avg detection quality':<28} {'0.125':>13} {'1.000':>14} {'n/a':>8}",
        f"{'Total runtime':<28} {'6.0s':>13} {'0.0s':>14} {'9.0s':>8}",
        f"{'Avg time per image':<28} {'2.0s':>13} {'0.0s':>14} {'9.0s':>8}",
    ]
    assert page[12:] == [
        "=" * 66,
        "",
        "BioCLIP+SAM  : best spatial precision (pixel mask, SAM 1).",
        "BioCLIP+YOLO : fastest; bounding boxes for large-scale runs.",
        "SAM 3        : text-prompted concept segmentation, single model.",
    ]
    none = aggregates.pipeline_comparison(detections.limit(0), runs.limit(0))
    lines = [r.text for r in reports.in_order(reports.comparison_report(none, "x")).collect()]
    assert lines[8] == f"{'Avg confidence':<28} {'n/a':>13} {'n/a':>14} {'n/a':>8}"


def test_evaluation_page(evaluation):
    def page(df):
        lines = reports.evaluation_report(
            aggregates.top1_accuracy(df),
            aggregates.per_species_accuracy(df),
            aggregates.confusions(df),
            ["buffalo", "zebra", "lioncub"],
        )
        return [r.text for r in reports.in_order(lines).collect()]

    lines = page(evaluation)
    assert f"{'Total images evaluated:':<36} 22" in lines
    assert f"{'Overall top-1 accuracy:':<36} 22.7%" in lines
    at = lines.index(f"{'buffalo':<22} {2:>8} {0:>9} {0.0:>9.1f}% ✗")
    assert lines[at + 1] == f"{'zebra':<22} {16:>8} {3:>9} {18.8:>9.1f}% ✗"
    assert lines[at + 2] == f"{'lioncub':<22} {4:>8} {2:>9} {50.0:>9.1f}% ✓"
    assert lines[-5] == f"  {'zebra':<18} → {'lioncub':<18} (13 times)"
    assert lines[1] == "BioCLIP Multi-Species Evaluation — Top-1 Accuracy"
    assert "Incorrect predictions (top misclassifications):" in lines
    assert lines[-2:] == ["", "Full results: "]
    assert page(evaluation.filter("correct"))[-3] == "  (no incorrect predictions)"
    assert f"{'Overall top-1 accuracy:':<36} 0.0%" in page(evaluation.limit(0))


def test_model_comparison(spark):
    rows = [("zebra", True, True), ("zebra", True, False), ("lioncub", False, True),
            ("lioncub", False, True)]
    combined = spark.createDataFrame(
        rows, "true_species string, bioclip_correct boolean, megadetector_localised boolean"
    ).withColumn("combined_correct", F.col("bioclip_correct") & F.col("megadetector_localised")
    ).withColumn("bioclip_predicted", F.lit("zebra"))
    runs = spark.createDataFrame([("identification", 8.0)], "stage string, elapsed_s double")
    got = {r.stage: r for r in aggregates.model_comparison(combined, runs).collect()}
    assert got["identification"].rate_pct == 50.0
    assert got["identification"].seconds_per_image == 2.0
    assert got["localisation"].correct == 3 and got["combined"].correct == 1
    by = {r.true_species: r for r in aggregates.model_comparison_by_species(combined).collect()}
    assert by["zebra"].winner == "BioCLIP" and by["lioncub"].winner == "MegaDetector"
    empty = {r.stage: r for r in aggregates.model_comparison(combined.limit(0), runs).collect()}
    assert empty["combined"].rate_pct is None
    confused = aggregates.confusions(combined, 8, "bioclip_predicted", "bioclip_correct")
    lines = reports.model_report(
        aggregates.model_comparison(combined, runs),
        aggregates.model_comparison_by_species(combined),
        confused,
        ["zebra", "lioncub"],
    )
    page = [r.text for r in reports.in_order(lines).collect()]
    assert f"{'Accuracy / Localisation rate':<40} {'50.0%':>10} {'75.0%':>8} {'25.0%':>10}" in page
    assert f"{'Total runtime':<40} {'8.0s':>10} {'—':>8} {'—':>10}" in page
    assert f"{'zebra':<22} {100.0:>9.1f}% {50.0:>7.1f}% {50.0:>9.1f}% {2:>4}" in page
    assert f"  {'lioncub':<18} -> {'zebra':<18} (2 times)" in page


def test_count_page(spark):
    accuracy = spark.createDataFrame(
        [("bioclip_yolo", 1.25, 2.0, 0.75, 50.0), ("bioclip_sam", 3.0, None, None, 0.0)],
        "pipeline string, mean_count double, mean_gt double, mae double, exact_pct double")
    page = [r.text for r in reports.in_order(reports.count_report(accuracy, "zebra")).collect()]
    assert page[6] == f"{'bioclip_sam':<28} {3.0:>10.1f} {'nan':>9} {'nan':>7} {0.0:>7.1f}%"
    assert page[7] == f"{'bioclip_yolo':<28} {1.25:>10.1f} {2.0:>9.1f} {0.75:>7.1f} {50.0:>7.1f}%"


def test_site_summary_drops_rows_without_site(spark):
    df = spark.createDataFrame(
        [("i1", "S1", "kopje", True, 0.5), ("i2", "S1", "kopje", False, 1.0),
         ("i3", "S2", "kopje", True, 0.5), ("i4", None, "kopje", True, 0.5),
         ("i5", "S3", None, True, 0.5)],
        "image_id string, camera_id string, habitat_type string, correct boolean, "
        "confidence double")
    got = [tuple(r) for r in aggregates.site_summary(df).collect()]
    assert got == [("S1", "kopje", 2, 1, 0.75, 50.0), ("S2", "kopje", 1, 1, 0.5, 100.0)]


def test_histogram_edges(spark, rows):
    df = spark.createDataFrame(
        [(True, 0.0), (True, 0.039), (True, 0.04), (False, 1.0), (False, 0.99), (True, None)],
        "correct boolean, confidence double")
    got = rows(aggregates.confidence_histogram(df), "correct", "bin", "images")
    assert got == [(False, 24, 2), (True, 0, 2), (True, 1, 1)]


def test_quartiles_of_hot_and_skewed_values(spark):
    """Many equal values, values within one slice, a single value, values outside."""
    rng = np.random.default_rng(2)
    groups = {
        "ties": [0.0] * 500 + list(rng.uniform(0, 1, 501)),
        "close": list(0.5 + rng.uniform(0, 1e-9, 300)),
        "one": [0.7],
        "outside": list(rng.uniform(-3, 4, 200)),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("ties", None)]
    df = spark.createDataFrame(rows, "pipeline string, detection_quality double")
    for few in (False, True):
        got = {r.pipeline: r for r in aggregates.quality_box_stats(df, few_values=few).collect()}
        for group, values in groups.items():
            want = np.quantile(values, aggregates.QUARTILES)
            assert got[group].n == len(values)
            found = [got[group][n] for n in aggregates.QUARTILE_NAMES]
            assert np.allclose(found, want, rtol=0, atol=1e-12)


def test_dataset_overview(spark, detections):
    images = spark.createDataFrame(
        [("a", "zebra", "S1"), ("b", "zebra", "S2"), ("c", None, "S2")],
        "image_id string, species_label string, site_id string")
    got = aggregates.dataset_overview(images, detections).first()
    assert tuple(got) == (3, 1, 2, 50.0, 2)
    none = aggregates.dataset_overview(images.limit(0), detections.limit(0)).first()
    assert tuple(none) == (0, 0, 0, None, 0)


def test_small_summaries(spark, detections):
    shown = aggregates.detection_metrics(
        detections.withColumn("localised", F.lit(True))).first()
    assert (shown.images, shown.accuracy_pct, shown.localised) == (4, 50.0, 4)
    assert shown.confidence_pct == 62.5
    export = {r.pipeline: r for r in aggregates.export_summary(detections).collect()}
    assert export["bioclip_yolo"].accuracy_pct == 100.0
    confidence = {r.pipeline: r for r in aggregates.confidence_by_pipeline(detections).collect()}
    assert confidence["bioclip_sam"].confidence_pct == 50.0
    assert confidence["bioclip_sam"].pipeline_label == "BioCLIP + SAM 3"


def test_summaries_of_a_tally_equal_those_of_its_rows(spark, rows):
    made = [
        (label, guess, None if k % 7 == 0 else label == guess, None if k % 5 == 0 else k % 3 == 0)
        for k, (label, guess) in enumerate([("zebra", "zebra"), ("zebra", "eland"), ("eland", None), (None, "eland"), ("eland", "zebra")] * 9)
    ]
    models = spark.createDataFrame(
        made, "true_species string, bioclip_predicted string, bioclip_correct boolean, megadetector_localised boolean"
    ).withColumn("combined_correct", F.col("bioclip_correct") & F.col("megadetector_localised"))
    evaluation = models.withColumnsRenamed({"bioclip_predicted": "predicted_species", "bioclip_correct": "correct"})
    for given in (models, models.limit(0)):
        tallied = aggregates.tally(given, "bioclip_predicted", "bioclip_correct", list(aggregates.STAGE_FLAGS.values()))
        assert rows(aggregates.model_comparison_from(tallied)) == rows(aggregates.model_comparison(given))
        assert rows(aggregates.model_comparison_by_species_from(tallied)) == rows(aggregates.model_comparison_by_species(given))
        found = aggregates.confusions_from(tallied, 2).collect()
        assert found == aggregates.confusions(given, 2, "bioclip_predicted", "bioclip_correct").collect()
    for given in (evaluation, evaluation.limit(0)):
        tallied = aggregates.tally(given)
        assert rows(aggregates.top1_accuracy_from(tallied)) == rows(aggregates.top1_accuracy(given))
        assert rows(aggregates.per_species_accuracy_from(tallied)) == rows(aggregates.per_species_accuracy(given))
        assert aggregates.confusions_from(tallied).collect() == aggregates.confusions(given).collect()
