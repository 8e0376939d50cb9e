import json

import pytest
from pyspark.sql import functions as F

from spoorline import schemas
from spoorline.operators import joins
from spoorline.sources import files, listing, sinks, tables

IMAGE_ROWS = [
    ("007", "images/007.jpg", "zebra", "2010-07-20 06:14:06", "S1", -2.5, 34.5, "kopje"),
    ("8", 'odd, "quoted" name.jpg', "lioncub", None, "S2", None, None, None),
]


@pytest.fixture
def images(spark):
    return spark.createDataFrame(IMAGE_ROWS, schemas.IMAGES)


@pytest.fixture
def detections(spark):
    base = spark.createDataFrame(
        [("i1", "bioclip_sam", "zebra"), ("i2", "bioclip_yolo", "zebra"),
         ("i3", "bioclip_yolo", "lioncub"), ("i4", "other", "zebra")],
        "image_id string, pipeline string, species string")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in schemas.DETECTIONS.fields
             if f.name not in base.columns}
    return base.withColumns(blank).select(*schemas.DETECTIONS.fieldNames())


def test_images_as_csv_keep_text_ids(spark, images, tmp_path, rows):
    path = str(tmp_path / "images")
    sinks.write_enriched_images(images, path)
    back = tables.read_images(spark, path)
    assert back.schema == schemas.IMAGES
    assert rows(back) == rows(images)
    assert [r.image_id for r in tables.read_species(spark, path, "zebra").collect()] == ["007"]


def test_filter_reaches_the_parquet_scan(spark, images, tmp_path, plan):
    path = str(tmp_path / "images")
    images.write.parquet(path)
    text = plan(tables.read_species(spark, path, "zebra", fmt="parquet").select("image_id"))
    assert "EqualTo(species_label,zebra)" in text
    assert "ReadSchema: struct<image_id:string,species_label:string>" in text


def test_enriched_images_replace_the_table_they_are_read_from(spark, images, tmp_path, rows):
    path = str(tmp_path / "metadata")
    sinks.write_enriched_images(images, path, "parquet")
    table = tables.read_images(spark, path, "parquet")
    enriched = table.withColumns(
        {c: F.lit("1") if c == "ground_truth_count" else F.lit(1.0)
         for c in schemas.GROUND_TRUTH_COLUMNS}
    ).withColumn("ground_truth_count_num", F.lit(1))
    sinks.write_enriched_images(enriched, path, "parquet")
    back = tables.read_images(spark, path, "parquet", enriched=True)
    assert back.schema == schemas.ENRICHED_IMAGES and back.count() == 2
    assert len(list((tmp_path / "metadata").glob("version-*"))) == 2
    sinks.drop_versions(spark, path)
    assert len(list((tmp_path / "metadata").glob("version-*"))) == 1
    assert tables.read_images(spark, path, "parquet", enriched=True).count() == 2


def test_first_existing(spark, tmp_path):
    there = tmp_path / "b"
    there.mkdir()
    paths = [str(tmp_path / "a"), str(there), str(tmp_path)]
    assert tables.first_existing(spark, paths) == str(there)
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, paths[:1])


def test_detections_by_folder(spark, detections, tmp_path, rows, plan):
    path = str(tmp_path / "detections")
    assert tables.read_detections(spark, path).count() == 0
    sinks.write_detections(detections, path)
    back = tables.read_detections(spark, path, "bioclip_yolo", "zebra")
    assert back.columns == schemas.DETECTIONS.fieldNames()
    assert rows(back, "image_id") == [("i2",)]
    assert "PartitionFilters: [isnotnull(pipeline" in plan(back)
    everything = tables.read_all_detections(spark, path, "zebra")
    assert rows(everything, "image_id") == [("i1",), ("i2",)]
    # Writing again replaces the folders it covers and leaves the others.
    newer = detections.filter("image_id = 'i2'").withColumn("image_id", F.lit("i9"))
    sinks.write_detections(newer, path)
    assert rows(tables.read_detections(spark, path), "image_id") == [
        ("i1",), ("i3",), ("i4",), ("i9",)]
    sinks.write_detections(detections.limit(0), path)
    assert tables.read_detections(spark, path).count() == 4


def test_csv_exports(spark, detections, tmp_path, rows):
    path = str(tmp_path / "csv")
    sinks.write_merged(detections, path)
    assert rows(tables.read_detections_csv(spark, path)) == rows(detections)
    one = str(tmp_path / "one")
    sinks.export_csv(detections.filter("pipeline = 'other'"), one)
    assert tables.read_detections_csv(spark, one).count() == 1


ANNOTATIONS = [
    {"image_id": "a", "count": "1", "standing": 0.5},
    {"image_id": "b", "count": 3},
    {"image_id": "a", "count": "11-50", "young_present": 1.0, "moving": None},
    {"count": "9"},
]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("lines", [False, True])
def test_annotation_document(spark, tmp_path, indent, lines):
    path = tmp_path / "annotations.json"
    images = [{"id": "a", "file_name": "a.jpg", "image_id": "foreign"}]
    nested = [*ANNOTATIONS, {"image_id": "n", "count": "2", "extra": {"a": "}", "b": [{}]}}]
    document = {"info": {"year": 2010}, "images": images, "annotations": nested}
    path.write_text(json.dumps(document, indent=None if lines else indent))
    back = tables.read_annotations(spark, str(path), lines).orderBy("pos").collect()
    kept = [r for r in back if r.image_id]
    expected = [("a", "1"), ("b", "3"), ("a", "11-50"), ("n", "2")]
    assert [(r.image_id, r["count"]) for r in kept] == expected
    assert kept[2].young_present == 1.0 and kept[2].moving is None


def test_annotations_in_many_splits_keep_their_order(spark, tmp_path):
    from spoorline.operators.joins import enrich_ground_truth

    path = tmp_path / "annotations.json"
    rows = [{"image_id": f"i{n % 50}", "count": str(n % 10 + 1), "standing": n / 5000}
            for n in range(5000)]
    documents = [{"annotations": rows[k : k + 100]} for k in range(0, 5000, 100)]
    path.write_text("\n".join(map(json.dumps, documents)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        back = tables.read_annotations(spark, str(path), lines=True)
        assert back.rdd.getNumPartitions() > 5
        images = spark.createDataFrame([(f"i{n}",) for n in range(50)], "image_id string")
        out = enrich_ground_truth(images, back)
        got = {r.image_id: (r.ground_truth_count, r.gt_standing) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert back.count() == 5000
    assert got == {r["image_id"]: (r["count"], r["standing"]) for r in rows}


def test_a_malformed_csv_value_fails_the_job(spark, tmp_path):
    path = tmp_path / "images.csv"
    names = schemas.IMAGES.fieldNames()
    values = ["x"] * len(names)
    values[names.index("latitude")] = "north"
    path.write_text(",".join(names) + "\n" + ",".join(values) + "\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_images(spark, str(path)).collect()


def test_a_broken_annotation_fails_the_job(spark, tmp_path):
    path = tmp_path / "annotations.json"
    path.write_text('{"annotations": [{"image_id": "a", "count": }]}')
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        tables.read_annotations(spark, str(path)).collect()


def test_results(spark, tmp_path, rows):
    missing = str(tmp_path / "missing")
    assert tables.read_evaluation(spark, missing).count() == 0
    assert tables.read_comparison(spark, missing).count() == 0
    assert tables.read_scores(spark, missing).count() == 0
    wide = spark.createDataFrame(
        [("a", "p", "zebra", "zebra", True, 0.5, 0.5, "S1", 0.0, 0.0, 0.5, 0.1)],
        schemas.EVALUATION.fieldNames() + ["score_zebra", "score_lion"])
    path = str(tmp_path / "wide")
    sinks.write_evaluation(wide, path, "csv")
    back = tables.read_evaluation(spark, path, "csv", ["zebra", "lion"])
    assert rows(back) == rows(wide)
    models = spark.createDataFrame(
        [("a", "p", "zebra", "zebra", True, 0.5, 0.5, True, 0.9, "x", True)],
        schemas.MODEL_COMPARISON)
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        sinks.write_model_comparison(models, path, fmt)
        assert rows(tables.read_comparison(spark, path, fmt)) == rows(models)


def test_files_and_reports(spark, tmp_path, plan):
    folder = tmp_path / "overlays"
    folder.mkdir()
    for name in ("b_overlay.jpg", "a_overlay.jpg", "c.jpg"):
        (folder / name).write_bytes(b"xyz")
    listed = files.list_overlays(spark, str(folder))
    assert [r.path.rsplit("/", 1)[1] for r in listed.collect()] == [
        "a_overlay.jpg", "b_overlay.jpg"]
    assert "content" not in plan(files.list_files(spark, str(folder)))
    assert len(files.list_overlays(spark, str(folder), 1).collect()) == 1
    assert {bytes(r.content) for r in files.read_image_files(spark, str(folder)).collect()} == {
        b"xyz"}
    report = str(tmp_path / "report")
    assert files.read_report(spark, report) == ""
    lines = spark.createDataFrame(
        [(2, 0.0, "", "last"), (1, 2.0, "", "third"), (1, -1.0, "b", "second"),
         (1, -1.0, "a", "first"), (2, -1.0, "", "")],
        "section int, rank double, name string, text string").repartition(4)
    sinks.write_report(lines, report)
    assert files.read_report(spark, report) == "first\nsecond\nthird\n\nlast"


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_file_order_is_the_same_for_any_split_size(spark, tmp_path, fmt):
    path = str(tmp_path / "images")
    ids = spark.range(0, 3000, 1, 3)
    given = {"image_id": F.col("id").cast("string"), "species_label": F.when(F.col("id") % 3 == 0, "zebra").otherwise("eland")}
    frame = ids.select(*[given.get(t.name, F.col("id").cast(t.dataType)).alias(t.name) for t in schemas.IMAGES])
    frame.write.option("header", True).option("parquet.block.size", 4096).format(fmt).save(path)
    kept, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size in ("3000", "17000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            images = tables.read_images(spark, path, fmt, ordered=True)
            found.append({r.image_id: r.seq for r in images.collect()})
            zebras = tables.read_species(spark, path, "zebra", fmt=fmt, ordered=True).collect()
            assert {r.image_id: r.seq for r in zebras} == {i: s for i, s in found[-1].items() if int(i) % 3 == 0}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert found[0] == found[1] == found[2] == {str(k): k for k in range(3000)}
    empty = str(tmp_path / "none")
    frame.limit(0).write.option("header", True).format(fmt).save(empty)
    assert tables.read_images(spark, empty, fmt, ordered=True).count() == 0


def test_tasks_list_a_tree(spark, tmp_path, rows):
    root = tmp_path / "tree"
    for folder in ("", "a", "a/b", "a/b/c", "empty", "_hidden", ".git"):
        (root / folder).mkdir(exist_ok=True)
    for name in ("top.jpg", "a/one.jpg", "a/b/two.jpg", "a/b/c/three.JPG", "a/.dot.jpg", "_hidden/x.jpg", ".git/y.jpg", "a/none.jpg"):
        (root / name).write_bytes(b"" if "none" in name else name.encode())
    (root / "a/cycle").symlink_to(root)
    (root / "a/broken.jpg").symlink_to(root / "nowhere")
    (root / "a/linked.jpg").symlink_to(root / "top.jpg")
    expected = {"top.jpg": 7, "a/one.jpg": 9, "a/b/two.jpg": 11, "a/none.jpg": 0, "a/linked.jpg": 7}

    def names(listed):
        return {r.path.removeprefix(f"{root}/"): r.length for r in listed.collect()}

    assert names(files.list_tree(spark, str(root), "*.jpg")) == expected
    assert names(files.list_tree(spark, f"file://{root}/")) == {**expected, "a/b/c/three.JPG": 15}
    assert names(files.list_tree(spark, str(root), "t*.[jJ]??")) == {"top.jpg": 7, "a/b/two.jpg": 11, "a/b/c/three.JPG": 15}
    assert files.list_tree(spark, str(root / "empty")).collect() == []
    with pytest.raises(FileNotFoundError):
        files.list_tree(spark, str(root / "missing"))
    # a lister of one's own, and Arrow's, which serves stores with a URI
    deep = files.list_tree(spark, str(root), entries=lambda f: [("d", 0, True)] if f.count("/d") < 3 else [("f", 5, False)])
    assert [tuple(r) for r in deep.collect()] == [(f"{root}/d/d/d/f", 5)]
    found = sorted(listing.entries_of(f"file://{root}/a/b"))
    assert found == [("c", 0, True), ("two.jpg", 11, False)]
    assert list(listing.entries_of(f"file://{root}/missing")) == list(listing.entries_of(f"{root}/missing")) == []


def test_a_listing_by_tasks_equals_the_drivers(spark, tmp_path, rows):
    for site in range(30):
        folder = tmp_path / "overlays" / f"S{site % 7}" / str(site)
        folder.mkdir(parents=True)
        for k in range(site):
            (folder / f"{k}_overlay.jpg").write_bytes(b"x" * (k + 1))
    path = str(tmp_path / "overlays")
    assert rows(files.list_tree(spark, path, "*_overlay.jpg")) == rows(files.list_files(spark, path, "*_overlay.jpg"))
    by_tasks = files.list_overlays(spark, path, 40, by_tasks=True).collect()
    assert by_tasks == files.list_overlays(spark, path, 40).collect() and len(by_tasks) == 40
    for fmt in ("csv", "parquet"):
        files.write_inventory(files.list_tree(spark, path), str(tmp_path / fmt), fmt)
        assert rows(files.read_inventory(spark, str(tmp_path / fmt), fmt)) == rows(files.list_files(spark, path))


def _rows_scanned(frame):
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_reading_one_label_or_image_skips_row_groups(spark, tmp_path, rows):
    hadoop = spark._jsc.hadoopConfiguration()
    kept = hadoop.get("parquet.block.size")
    hadoop.set("parquet.block.size", "4096")
    try:
        ids = spark.range(0, 8000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("image_id"), "id")
        label = F.when(F.col("id") % 50 == 0, "zebra").when(F.col("id") % 3 == 0, "eland").otherwise("topi")
        images = ids.select("image_id", label.alias("species_label"), "id")
        path, stored = str(tmp_path / "images"), str(tmp_path / "detections")
        sinks.write_clustered(images, path)
        given = {"image_id": F.col("image_id"), "species": label, "pipeline": F.lit("bioclip_sam")}
        sinks.write_detections(ids.select(*[given.get(t.name, F.lit(None).cast(t.dataType)).alias(t.name) for t in schemas.DETECTIONS]), stored)
    finally:
        hadoop.set("parquet.block.size", kept) if kept else hadoop.unset("parquet.block.size")
    back = spark.read.parquet(path)
    assert rows(back) == rows(images)
    zebras = back.filter("species_label = 'zebra'")
    assert zebras.count() == 160 and _rows_scanned(zebras) < 1000
    one = images.filter("id = 4321").first().image_id
    assert _rows_scanned(back.filter(F.col("image_id") == one)) < 1000
    found = tables.read_detections(spark, stored, image_ids=[one])
    assert [r.image_id for r in found.collect()] == [one] and _rows_scanned(found) < 1000
    assert tables.read_detections(spark, stored).count() == 8000


def test_tables_in_buckets_join_without_a_shuffle(spark, tmp_path, rows, plan):
    ids = spark.range(0, 3000, 1, 3)
    image = F.col("id").cast("string").alias("image_id")
    detections = ids.select(image, F.lit("zebra").alias("species"), F.col("id").alias("n"))
    truth = ids.filter("id % 3 > 0").select(
        F.col("id").cast("string").alias("image_id"), F.when(F.col("id") % 2 == 0, "zebra").otherwise("topi").alias("species_label"), F.col("id").alias("seq"))
    annotations = truth.select("image_id", F.lit("2").alias("count"), F.col("seq").alias("pos"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = {
            name: sinks.write_bucketed(frame, f"in_buckets_{name}", str(tmp_path / name), 6)
            for name, frame in (("detections", detections), ("truth", truth), ("annotations", annotations))
        }
        judged = joins.with_ground_truth(kept["detections"], kept["truth"])
        assert "Exchange" not in plan(judged)
        assert rows(judged) == rows(joins.with_ground_truth(detections, truth))
        enriched = joins.enrich_ground_truth(kept["detections"], kept["annotations"])
        assert "Exchange" not in plan(enriched)
        assert rows(enriched) == rows(joins.enrich_ground_truth(detections, annotations))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("detections", "truth", "annotations"):
            spark.sql(f"DROP TABLE IF EXISTS in_buckets_{name}")
