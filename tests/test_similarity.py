import pytest
from pyspark.sql import functions as F

from spoorline.operators import ranking, similarity

IMAGE = "image_id string, seq int, species_label string, embedding array<float>"


@pytest.fixture
def prompts(spark):
    rows = [("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0]), ("twin", 2, [0.0, 1.0])]
    return spark.createDataFrame(rows, "species string, ord int, embedding array<float>")


@pytest.fixture
def images(spark):
    rows = [
        ("i1", 1, "a", [2.0, 0.0]),
        ("i2", 2, "a", [1.0, 1.0]),
        ("i3", 3, "a", None),
        ("i4", 4, "b", [0.0, 3.0]),
        ("i5", 5, "twin", [0.0, 1.0]),
        ("i6", 6, "c", [1.0, 0.2]),
        ("i7", 7, "a", [3.0, 3.0]),
    ]
    return spark.createDataFrame(rows, IMAGE)


@pytest.mark.parametrize("block_prompts", [1, 2, 4096])
@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_top1(images, prompts, block_prompts, engine):
    blocks = similarity.prompt_blocks(prompts, block_prompts)
    assert sum(len(b.species) for b in blocks) == 3
    out = similarity.top1_species(images, blocks, engine=engine, wide=True)
    found = {r.image_id: r for r in out.collect()}
    assert "i3" not in found  # unreadable
    assert found["i4"].predicted_species == "b"  # equal scores: first in order
    assert found["i5"].predicted_species == "b" and found["i5"].correct is False
    assert found["i1"].correct is True
    assert found["i2"].predicted_species == "a"  # tie of a and b
    assert found["i6"].true_species_score == 0.0  # its label has no prompt
    assert found["i2"].top1_score == pytest.approx(0.7071)
    assert found["i2"].score_b == pytest.approx(0.7071)
    assert found["i5"].true_species_score == 1.0


@pytest.mark.parametrize("block_prompts", [2, 4096])
def test_score_all_has_every_pair(images, prompts, block_prompts):
    out = similarity.score_all(images, prompts, block_prompts=block_prompts)
    assert out.count() == 6 * 3
    assert out.select("image_id", "species").distinct().count() == 18


def test_score_wide(images, prompts):
    long = similarity.score_all(images, prompts)
    wide = {r.image_id: r for r in similarity.score_wide(long, ["a", "b"]).collect()}
    assert wide["i1"].score_a == 1.0 and wide["i1"].score_b == 0.0
    assert wide["i1"].asDict().keys() == {"image_id", "score_a", "score_b"}


def test_rank_by_species(images, prompts, rows):
    out = similarity.rank_by_species(images, prompts, "a", 4)
    assert rows(out, "image_id") == [("i1",), ("i2",), ("i6",), ("i7",)]
    first = {r.image_id: r for r in out.collect()}
    assert first["i1"].confidence == 1.0
    # More wanted than there are; unreadable ones score 0 and stay.
    everything = similarity.rank_by_species(images, prompts, "a", 100)
    scores = {r.image_id: r for r in everything.collect()}
    assert len(scores) == 7
    assert scores["i3"].bioclip_score == 0.0 and scores["i3"].confidence == 0.0


def test_rank_ties_keep_table_order(images, prompts):
    out = similarity.rank_by_species(images, prompts, "a", 3).collect()
    assert [r.image_id for r in out] == ["i1", "i6", "i2"]  # i7 ties with i2, later


def test_equal_scores_are_certain(spark, prompts):
    rows = [(f"i{n}", n, "a", [1.0, 0.0]) for n in range(3)]
    images = spark.createDataFrame(rows, IMAGE)
    assert {r.confidence for r in
            similarity.rank_by_species(images, prompts, "a", 5).collect()} == {1.0}
    one = similarity.rank_by_species(images.limit(1), prompts, "a", 5).collect()
    assert [r.confidence for r in one] == [1.0]


def test_rank_each_equals_rank_by(images, prompts, rows):
    each = similarity.rank_each_species(images, prompts, 2)
    for label in ("a", "b", "twin"):
        alone = similarity.rank_by_species(
            images.filter(F.col("species_label") == label), prompts, label, 2
        )
        columns = ["image_id", "bioclip_score", "confidence"]
        assert rows(each.filter(F.col("species_label") == label), *columns) == rows(
            alone, *columns
        )


def test_minmax_per_group_and_overall(spark, rows):
    scored = spark.createDataFrame(
        [("x", "a", 0.0), ("y", "a", 1.0), ("z", "b", 5.0)],
        "image_id string, species_label string, bioclip_score double",
    )
    overall = similarity.minmax_confidence(scored)
    assert rows(overall, "image_id", "confidence") == [("x", 0.0), ("y", 0.2), ("z", 1.0)]
    grouped = similarity.minmax_confidence(scored, "species_label")
    assert rows(grouped, "image_id", "confidence") == [("x", 0.0), ("y", 1.0), ("z", 1.0)]
    unnamed = scored.unionByName(scored.withColumn("species_label", F.lit(None).cast("string")))
    got = rows(similarity.minmax_confidence(unnamed, "species_label").filter("species_label IS NULL"), "image_id", "confidence")
    assert got == [("x", 0.0), ("y", 0.2), ("z", 1.0)]


def test_prompts_need_an_order_without_repeats(spark):
    shape = "species string, ord int, embedding array<double>"
    for bad in ([("a", 0, [1.0]), ("b", 0, [2.0])], [("a", None, [1.0]), ("b", 1, [2.0])]):
        with pytest.raises(ValueError, match="ord"):
            similarity.prompt_blocks(spark.createDataFrame(bad, shape))


@pytest.mark.parametrize("engine", ["arrow", "sql"])
@pytest.mark.parametrize("wide", [False, True])
def test_block_size_does_not_matter_with_repeated_images(spark, rows, engine, wide):
    images = spark.createDataFrame(
        [("x", "a", [1.0, 0.0]), ("x", "b", [1.0, 0.0]), ("y", "d", [0.6, 0.8]), ("z", "a", [0.0, 0.0])],
        "image_id string, species_label string, embedding array<double>")
    prompts = spark.createDataFrame(
        [("a", 0, [1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("c", 2, [0.0, 1.0]), ("d", 3, [0.6, 0.8])],
        "species string, ord int, embedding array<double>")
    found = {n: rows(similarity.top1_species(images, prompts, engine, wide, n)) for n in (1, 2, 4)}
    assert found[1] == found[2] == found[4] and len(found[1]) == 4
    best = {(r[0], r[1]): r[2] for r in found[1]}
    assert best == {("x", "a"): "a", ("x", "b"): "a", ("y", "d"): "d", ("z", "a"): None}


def test_scores_are_read_once(spark, plan):
    images = spark.createDataFrame(
        [("x", "a", 1, [1.0, 0.0]), ("y", "a", 2, [0.0, 1.0])],
        "image_id string, species_label string, seq int, embedding array<double>")
    prompts = spark.createDataFrame([("a", 0, [1.0, 0.0])], "species string, ord int, embedding array<double>")
    for ranked in (similarity.rank_each_species(images, prompts, 5), similarity.rank_by_species(images, prompts, "a", 5)):
        assert "ArrowEvalPython" not in plan(ranked) and "embedding" not in plan(ranked)
        assert ranked.count() == 2


@pytest.mark.parametrize("n", [1, 7, 150, 1200, 5000])
def test_top_n_of_a_hot_group(spark, n):
    """One label holds most rows; the result is whole and exact for small and large n."""
    df = spark.range(0, 3000, 1, 6).select(
        F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("species_label"),
        ((F.col("id") * 7919) % 3001).alias("seq"),
    )
    want = {}
    for r in df.collect():
        want.setdefault(r.species_label, []).append(r.seq)
    want = {k: sorted(v)[:n] for k, v in want.items()}
    for labels in (None, ["hot", "rare", "absent"]):
        got = {}
        for r in ranking.head_per_species(df, n, labels=labels).collect():
            got.setdefault(r.species_label, []).append(r.seq)
        assert {k: sorted(v) for k, v in got.items()} == want


def test_large_n_is_merged_in_rounds(spark, plan):
    df = spark.range(0, 3000, 1, 6).select(
        (F.col("id") % 2).alias("species_label"), F.col("id").alias("seq"))
    assert plan(ranking.head_per_species(df, 15)).count("Exchange") == 1
    text = plan(ranking.head_per_species(df, 150))
    assert text.count("Exchange") == 2 and "row_number(), 150, Partial" in text
    assert plan(ranking.head_per_species(df, 1200)).count("Exchange") == 3


def test_no_head_keeps_all(images):
    assert ranking.head_per_species(images, None).count() == 7


def test_preview_and_sort(images, spark):
    assert [r.seq for r in ranking.preview(images, 3, "seq").collect()] == [1, 2, 3]
    df = spark.createDataFrame(
        [("b", 0.5, True), ("a", 0.5, False), ("c", 0.9, False)],
        "image_id string, confidence double, correct boolean",
    )
    order = {
        "confidence_high": ["c", "a", "b"],
        "confidence_low": ["a", "b", "c"],
        "correct_first": ["b", "a", "c"],
    }
    for name, want in order.items():
        assert [r.image_id for r in ranking.sort_detections(df, name).collect()] == want


def test_plans(images, prompts, plan):
    """No join, no shuffle of images for top-1; a bounded heap for top N."""
    top1 = plan(similarity.top1_species(images, prompts))
    assert "Exchange" not in top1 and "Join" not in top1
    assert "TakeOrderedAndProject" in plan(similarity.rank_by_species(images, prompts, "a", 3))
    assert "WindowGroupLimit" in plan(similarity.rank_each_species(images, prompts, 3))
