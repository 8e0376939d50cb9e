"""Queries on scoring, ranking and top-1 prediction."""

from pyspark.sql import functions as F

from spoorline.driver.registry import query, round4
from spoorline.driver.views import view
from spoorline.functions.similarity import species_prompt as prompt_text
from spoorline.operators import aggregates, filters, ranking, sets, similarity

SCORES = """
scores AS (
  SELECT g.image_id, g.seq, g.species_label, p.species, p.ord,
         round(list_cosine_similarity(CAST(g.embedding AS DOUBLE[]),
                                      CAST(p.embedding AS DOUBLE[])), 12) AS score
  FROM v_gallery g CROSS JOIN v_prompts p)
"""
TOP1 = f"""
{SCORES},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS rn,
         max(CASE WHEN species = species_label THEN score END)
           OVER (PARTITION BY image_id) AS own
  FROM scores),
top1 AS (
  SELECT image_id, species_label AS true_species, species AS predicted_species,
         species = species_label AS correct, round(1e-9 + score, 4) AS top1_score,
         round(1e-9 + coalesce(own, 0), 4) AS true_species_score
  FROM ranked WHERE rn = 1)
"""
OWN = f"""
{SCORES},
own AS (
  SELECT image_id, seq, species_label, score,
         min(score) OVER (PARTITION BY species_label) AS low,
         max(score) OVER (PARTITION BY species_label) AS high,
         row_number() OVER (PARTITION BY species_label ORDER BY score DESC, seq) AS rn
  FROM scores WHERE species = species_label)
"""
_CONFIDENCE = """round(1e-9 + CASE WHEN high > low THEN (score - low) / (high - low)
                            ELSE 1 END, 4) AS confidence"""


def top1(spark, sf_dir):
    images = view(spark, sf_dir, "v_gallery").select("image_id", "species_label", "embedding")
    return similarity.top1_species(images, view(spark, sf_dir, "v_prompts"))


@query(f"WITH {TOP1} SELECT * FROM top1")
def top1_species(spark, sf_dir):
    return top1(spark, sf_dir)


@query(f"WITH {TOP1} SELECT * FROM top1")
def top1_species_sql_engine(spark, sf_dir):
    """The same with Spark's own array functions in place of the Arrow product."""
    images = view(spark, sf_dir, "v_gallery").select("image_id", "species_label", "embedding")
    return similarity.top1_species(images, view(spark, sf_dir, "v_prompts"), engine="sql")


@query(f"""WITH {TOP1} SELECT count(*) AS total, count(*) FILTER (correct) AS correct,
  round(1e-9 + 100.0 * count(*) FILTER (correct) / count(*), 4) AS accuracy_pct FROM top1""")
def top1_accuracy(spark, sf_dir):
    out = aggregates.top1_accuracy(top1(spark, sf_dir))
    return out.withColumn("accuracy_pct", round4("accuracy_pct"))


@query(f"""WITH {TOP1}
SELECT true_species AS species, true_species AS display_name, count(*) AS images,
  count(*) FILTER (correct) AS correct,
  CAST(printf('%.1f', CAST(100.0 * count(*) FILTER (correct) / count(*) AS DOUBLE)) AS DOUBLE)
    AS accuracy_pct,
  100.0 * count(*) FILTER (correct) / count(*) >= 50 AS passed
FROM top1 GROUP BY true_species""")
def per_species_accuracy(spark, sf_dir):
    return aggregates.per_species_accuracy(top1(spark, sf_dir))


@query(f"""WITH {TOP1}
SELECT true_species, predicted_species, count(*) AS times FROM top1 WHERE NOT correct
GROUP BY 1, 2 ORDER BY times DESC, true_species, predicted_species LIMIT 10""")
def confusions(spark, sf_dir):
    return aggregates.confusions(top1(spark, sf_dir))


@query(f"""WITH {SCORES}
SELECT image_id, species, ord, round(1e-9 + score, 4) AS score FROM scores""")
def score_all(spark, sf_dir):
    scores = similarity.score_all(
        view(spark, sf_dir, "v_gallery"), view(spark, sf_dir, "v_prompts")
    )
    return scores.withColumn("score", round4("score"))


@query(
    f"WITH {SCORES} SELECT image_id, "
    + ", ".join(
        f"round(1e-9 + max(CASE WHEN species = '{i}' THEN score END), 4) AS score_{i}"
        for i in range(10)
    )
    + " FROM scores GROUP BY image_id"
)
def score_wide(spark, sf_dir):
    scores = similarity.score_all(
        view(spark, sf_dir, "v_gallery"), view(spark, sf_dir, "v_prompts")
    )
    return similarity.score_wide(scores, [str(i) for i in range(10)])


@query(f"""WITH {SCORES},
one AS (SELECT *, min(score) OVER () AS low, max(score) OVER () AS high,
               row_number() OVER (ORDER BY score DESC, seq) AS rn
        FROM scores WHERE species = '3')
SELECT image_id, species_label, round(1e-9 + score, 4) AS bioclip_score, {_CONFIDENCE}
FROM one WHERE rn <= 15""")
def rank_by_species(spark, sf_dir):
    """All images against one prompt, whatever their label."""
    images = view(spark, sf_dir, "v_gallery").select(
        "image_id", "seq", "species_label", "embedding"
    )
    ranked = similarity.rank_by_species(images, view(spark, sf_dir, "v_prompts"), "3", 15)
    return ranked.select(
        "image_id",
        "species_label",
        round4("bioclip_score").alias("bioclip_score"),
        round4("confidence").alias("confidence"),
    )


@query(f"""WITH {OWN}
SELECT image_id, species_label, round(1e-9 + score, 4) AS bioclip_score, {_CONFIDENCE}
FROM own WHERE rn <= 15""")
def rank_each_species(spark, sf_dir):
    images = view(spark, sf_dir, "v_gallery").select(
        "image_id", "seq", "species_label", "embedding"
    )
    ranked = similarity.rank_each_species(images, view(spark, sf_dir, "v_prompts"), 15)
    return ranked.select(
        "image_id",
        "species_label",
        round4("bioclip_score").alias("bioclip_score"),
        round4("confidence").alias("confidence"),
    )


@query(f"""WITH {OWN} SELECT image_id, species_label, {_CONFIDENCE} FROM own""")
def minmax_confidence(spark, sf_dir):
    images = view(spark, sf_dir, "v_gallery").select("image_id", "species_label", "embedding")
    scored = similarity.with_own_score(images, view(spark, sf_dir, "v_prompts"))
    out = similarity.minmax_confidence(scored, "species_label")
    return out.select("image_id", "species_label", round4("confidence").alias("confidence"))


@query("""SELECT image_id, species_label, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY species_label ORDER BY seq) AS rn FROM v_images)
WHERE rn <= 150""")
def head_per_species(spark, sf_dir):
    images = view(spark, sf_dir, "v_images").select("image_id", "species_label", "seq")
    return ranking.head_per_species(images, 150)


@query("""SELECT image_id, species_label, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY species_label ORDER BY seq) AS rn FROM v_images)
WHERE rn <= 1500 AND species_label IN ('view', 'click')""")
def concat_species(spark, sf_dir):
    images = view(spark, sf_dir, "v_images").select("image_id", "species_label", "seq")
    return sets.concat_species(images, ["view", "zebra", "click"], 1500)


@query("""SELECT DISTINCT species_label AS species,
  concat('a camera trap photo of a ', species_label, ' in African savanna') AS prompt
FROM v_images""")
def species_prompt(spark, sf_dir):
    labels = aggregates.available_species(view(spark, sf_dir, "v_images"))
    return labels.withColumn("prompt", prompt_text(F.col("species")))


@query("""SELECT s.species, CAST(s.ord AS INT) AS ord
FROM (VALUES ('view', 0), ('zebra', 1), ('click', 2), ('error', 3)) s(species, ord)
WHERE s.species IN (SELECT species_label FROM v_images)""")
def target_species(spark, sf_dir):
    return filters.target_species(
        view(spark, sf_dir, "v_images"), ["view", "zebra", "click", "error"]
    )
