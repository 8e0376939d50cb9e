import pytest

from spoorline.operators import detectors, models

BOX = ("image_id string, box_id int, class_id int, conf double, "
       "x1 int, y1 int, x2 int, y2 int")


@pytest.fixture
def boxes(spark):
    rows = [
        # two animals, one at exactly the threshold, and a better other class
        ("both", 0, 16, 0.2, 0, 0, 1, 1),
        ("both", 1, 25, 0.6, 1, 1, 2, 2),
        ("both", 2, 3, 0.9, 2, 2, 3, 3),
        # only other classes, tied
        ("other", 0, 1, 0.5, 0, 0, 1, 1),
        ("other", 1, 2, 0.5, 5, 5, 6, 6),
        # an animal under the threshold beside a better other class
        ("weak", 0, 20, 0.19, 0, 0, 1, 1),
        ("weak", 1, 0, 0.3, 7, 7, 8, 8),
        # tied animals; ids of two digits order as numbers
        ("tied", 10, 18, 0.7, 1, 0, 1, 1),
        ("tied", 9, 19, 0.7, 2, 0, 1, 1),
        # missing values
        ("null", 0, None, None, 0, 0, 1, 1),
        ("null", 1, 15, 0.1, 0, 0, 1, 1),
    ]
    return spark.createDataFrame(rows, BOX).repartition(3)


@pytest.fixture
def images(spark):
    names = ["both", "other", "weak", "tied", "null", "empty"]
    return spark.createDataFrame([(n,) for n in names], "image_id string")


def test_animal_boxes(boxes, rows):
    assert rows(detectors.animal_boxes(boxes), "image_id", "box_id") == sorted(
        [("both", 0), ("both", 1), ("other", 0), ("weak", 1), ("tied", 10), ("tied", 9),
         ("null", 1)],
        key=repr,
    )


def test_best_animal_box(boxes, rows):
    assert rows(detectors.best_animal_box(boxes), "image_id", "box_id") == sorted(
        [("both", 1), ("other", 0), ("weak", 0), ("tied", 9), ("null", 1)], key=repr
    )


def test_class_boxes(boxes, rows):
    assert rows(detectors.class_boxes(boxes), "image_id", "box_id") == sorted(
        [("both", 0), ("both", 1), ("tied", 9), ("tied", 10)], key=repr
    )


def test_best_box(boxes, rows):
    assert rows(detectors.best_box(boxes), "image_id", "box_id") == sorted(
        [("both", 2), ("other", 0), ("weak", 1), ("tied", 9), ("null", 1)], key=repr
    )


def test_category_boxes(spark, rows):
    raw = spark.createDataFrame(
        [
            ("a", 0, "1", 0.2, 0.1, 0.25, 0.5, 0.5),
            ("a", 1, "2", 0.9, 0.1, 0.25, 0.5, 0.5),
            ("a", 2, "1", 0.19, 0.1, 0.25, 0.5, 0.5),
        ],
        "image_id string, box_id int, category string, conf double, "
        "x double, y double, w double, h double",
    )
    out = detectors.category_boxes(raw, 1919, 1079)
    assert rows(out, "box_id", "x1", "y1", "x2", "y2") == [(0, 191, 269, 1151, 809)]


def test_localise_boxes(boxes, images, rows):
    columns = ["image_id", "location_type", "location", "detection_quality", "instance_count"]
    fused = rows(detectors.localise_animals(images, boxes), *columns)
    stepwise = rows(
        detectors.localise(images, detectors.animal_boxes(boxes), "bbox"), *columns
    )
    assert fused == stepwise
    assert fused == sorted(
        [
            ("both", "bbox", "1,1,2,2", 0.6, 2),
            ("other", "bbox", "0,0,1,1", 0.5, 1),
            ("weak", "bbox", "7,7,8,8", 0.3, 1),
            ("tied", "bbox", "2,0,1,1", 0.7, 2),
            ("null", "bbox", "0,0,1,1", 0.1, 1),
            ("empty", "bbox", "no_detection", 0.0, 0),
        ],
        key=repr,
    )


def test_masks(spark, images, rows):
    masks = spark.createDataFrame(
        [("both", 0, 0.4), ("both", 1, None), ("tied", 0, 0.8), ("tied", 1, 0.8)],
        "image_id string, mask_id int, conf double",
    )
    assert rows(detectors.mask_instances(masks), "image_id", "conf") == sorted(
        [("both", 0.4), ("both", 1.0), ("tied", 0.8), ("tied", 0.8)], key=repr
    )
    single = {r.image_id: r for r in detectors.single_mask(images, masks).collect()}
    assert single["tied"].mask_id == 0 and single["tied"].instance_count == 1
    assert single["both"].mask_id == 0  # a known confidence comes before none
    assert single["empty"].mask_id is None and single["empty"].instance_count == 0
    located = {r.image_id: r for r in
               models.pipeline("bioclip_sam").localise(images, masks).collect()}
    assert located["both"].location == "mask_saved"
    assert located["both"].detection_quality == 1.0 and located["both"].instance_count == 2
    assert located["empty"].location == "no_mask" and located["empty"].detection_quality == 0.0
    counts = {r.image_id: r.instance_count for r in
              detectors.instance_counts(images, masks).collect()}
    assert counts["both"] == 2 and counts["empty"] == 0


def test_hot_image_reduces_before_the_shuffle(spark, images, plan):
    """One image has nearly all boxes; the plan keeps one row of it per map task."""
    rows = [("both", i, 16 + i % 10, 0.2 + (i % 50) / 100, i, 0, 1, 1) for i in range(2000)]
    boxes = spark.createDataFrame(rows, BOX).repartition(5)
    located = detectors.localise_animals(images, boxes)
    assert "partial_min" in plan(located)
    best = {r.image_id: r for r in located.collect()}["both"]
    assert best.instance_count == 2000 and best.location == "49,0,1,1"


def test_registry(spark, images, boxes, rows):
    assert list(models.REGISTRY) == ["bioclip_sam", "bioclip_yolo", "bioclip_megadetector"]
    counted = models.pipeline("bioclip_megadetector").localise(images, boxes)
    assert ("other", "no_detection", 0) in rows(
        counted, "image_id", "location", "instance_count"
    )
    with pytest.raises(ValueError, match="unknown pipeline"):
        models.pipeline("sam9")
