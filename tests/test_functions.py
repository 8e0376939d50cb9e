import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorline.functions import geometry, measures, similarity, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "value, decimals",
    [(4.5, 0), (10.5, 0), (0.5, 0), (1.5, 0), (0.15, 1), (0.25, 1), (99.95, 1), (6.25, 1),
     (0.00015, 4), (0.12345, 4), (1234567.891, 2), (-0.05, 1), (0.0005, 3), (2.0, 4)],
)
def test_fixed_point_rounds_as_python_does(spark, value, decimals):
    shown = one(spark, text.fixed_point("x", decimals), x=value)
    assert shown == f"{value:.{decimals}f}"
    assert one(spark, text.round_exact("x", decimals), x=value) == round(value, decimals)


@pytest.mark.parametrize(
    "path, name, stem",
    [
        ("a/b/c.jpg", "c.jpg", "c"),
        ("c.tar.gz", "c.tar.gz", "c.tar"),
        ("a\\b\\d.JPG", "d.JPG", "d"),
        ("a/.hidden", ".hidden", ".hidden"),
        ("noext", "noext", "noext"),
        ("a.b/c", "c", "c"),
    ],
)
def test_file_names(spark, path, name, stem):
    assert one(spark, text.file_name("p"), p=path) == name
    assert one(spark, text.file_stem("p"), p=path) == stem


def test_names_and_colours(spark):
    assert one(spark, text.pretty_species("s"), s="lioncub") == "Lion (cub)"
    assert one(spark, text.pretty_species("s"), s="plains_zebra") == "Plains Zebra"
    assert one(spark, text.concept_prompt("s"), s="hyenabrown") == "brown hyena"
    assert one(spark, text.concept_prompt("s"), s="zebra") == "zebra"
    assert one(spark, text.species_colour("s"), s="Zebra") == "255,255,255"
    assert one(spark, text.species_colour("s"), s="yeti") == "0,200,255"
    assert one(spark, text.pipeline_label("s"), s="other") == "other"
    assert one(spark, text.pipeline_output("s"), s="other") == ""
    prompt = similarity.species_prompt("s")
    assert one(spark, prompt, s="zebra") == "a camera trap photo of a zebra in African savanna"


@pytest.mark.parametrize(
    "location, corners",
    [("1,2,30,40", (1, 2, 30, 40)), ("no_mask", None), ("", None), ("1,2,3", None),
     ("1,2,x,4", None), ("-3,0,5,6", (-3, 0, 5, 6))],
)
def test_boxes_as_text(spark, location, corners):
    box = one(spark, geometry.decode_box("p"), p=location)
    assert (tuple(box) if box else None) == corners
    if corners:
        values = dict(zip(geometry.CORNERS, corners))
        assert one(spark, geometry.encode_box(), **values) == location


def test_pixels_are_cut_toward_zero(spark):
    corners = geometry.to_pixels(F.lit(-0.0015), F.lit(0.3333), F.lit(0.5), F.lit(0.5), 1000, 500)
    row = spark.range(1).select(*[c.alias(n) for n, c in corners.items()]).first()
    assert tuple(row) == (-1, 166, 498, 416)


@pytest.mark.parametrize(
    "truth, species, verdict",
    [("zebra", "zebra", "correct"), ("lion", "zebra", "incorrect"),
     ("unknown", "zebra", "unknown"), (None, "zebra", "unknown"),
     ("unknown", "unknown", "correct")],
)
def test_verdicts(spark, truth, species, verdict):
    column = measures.correct_label(F.lit(truth).cast("string"), F.lit(species))
    assert spark.range(1).select(column).first()[0] == verdict


@pytest.mark.parametrize(
    "stored, correct",
    [("Correct", True), ("correct", True), ("incorrect", False), ("unknown", False), (None, False)],
)
def test_stored_verdict(spark, stored, correct):
    column = measures.is_correct(F.lit(stored).cast("string"))
    assert spark.range(1).select(column).first()[0] is correct


@pytest.mark.parametrize(
    "location, found",
    [(None, False), ("", False), ("no_mask", False), ("no_detection", False),
     ("mask_saved", True), ("1,2,3,4", True)],
)
def test_localised(spark, location, found):
    column = measures.is_localised(F.lit(location).cast("string"))
    assert spark.range(1).select(column).first()[0] is found


@pytest.mark.parametrize(
    "label, number",
    [("1", 1), ("10", 10), ("11-50", 15), ("51+", 51), ("12", 1), (None, 1), ("", 1)],
)
def test_count_numbers(spark, label, number):
    column = measures.count_midpoint(F.lit(label).cast("string"))
    assert spark.range(1).select(column).first()[0] == number


def test_social_structure(spark):
    sizes = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 6, None)], "n int")
    out = [r[0] for r in sizes.select(measures.social_structure("n")).collect()]
    assert out == [None, "solitary", "small group", "small group", "large herd", None]


def test_cosine_of_both_engines(spark):
    rng = np.random.default_rng(0)
    prompts = rng.normal(size=(3, 8))
    vectors = [list(map(float, v)) for v in rng.normal(size=(50, 8))] + [None, [0.0] * 8]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<float>")
    df = df.repartition(3)
    sql = [similarity.cosine("v", F.lit([float(x) for x in p])) for p in prompts]
    arrow = similarity.cosine_to_prompts(prompts)("v")
    at = F.col("i") % 4 - 1
    own = similarity.cosine_to_own_prompt(prompts)("v", at.cast("int"))
    for r in df.select("i", arrow.alias("arrow"), F.array(*sql).alias("sql"),
                       own.alias("own")).collect():
        if r.i < 50:
            v = np.array(vectors[r.i])
            want = prompts @ v / np.linalg.norm(prompts, axis=1) / np.linalg.norm(v)
            assert np.allclose(r.arrow, want, atol=1e-6)
            assert np.allclose(r.arrow, r.sql, atol=1e-9)
            place = r.i % 4 - 1
            assert r.own is None if place < 0 else abs(r.own - r.arrow[place]) < 1e-9
        else:
            assert r.own is None
            assert r.arrow is None or all(x is None for x in r.arrow)
            assert all(x is None for x in r.sql)


def test_round_exact_on_many_values(spark):
    rng = np.random.default_rng(1)
    ties = [n / 10**5 for n in range(5, 20000, 10)] + [n / 16 for n in range(-40, 40)]
    values = ties + list(map(float, rng.uniform(-2, 2, 2000))) + [0.0, 1e12, -3.5e8]
    values += [1234567890.123456, 1000000000.25, -4e12 - 0.05, -5e-05, 1e20]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for decimals in (0, 1, 4):
        for r in df.select("v", text.round_exact("v", decimals).alias("r")).collect():
            assert r.r == round(r.v, decimals), (r.v, decimals)
    null = spark.range(1).select(text.fixed_point(F.lit(None).cast("double"), 1)).first()[0]
    assert null is None
