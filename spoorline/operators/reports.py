"""Text reports as lines.

A report is a DataFrame of ``section``, ``rank``, ``name`` and ``text``; ordering
by the first three gives the page. Only metric rows, a few per pipeline or label,
ever become lines.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline import fixed_values as fixed
from spoorline.functions.text import fixed_point, pct

_LINE = "section int, rank double, name string, text string"


def _fixed_lines(spark: SparkSession, section: int, lines: Sequence[str]) -> DataFrame:
    numbered = [(section, float(i), "", line) for i, line in enumerate(lines)]
    return spark.createDataFrame(numbered, _LINE)


def _lines(
    df: DataFrame, section: int, rank: Column, text: Column, name: Column | None = None
) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        rank.cast("double").alias("rank"),
        (F.lit("") if name is None else name).alias("name"),
        text.alias("text"),
    )


def _page(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def in_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy("section", "rank", "name")


def _or(value: Column, otherwise: str) -> Column:
    return F.coalesce(value, F.lit(otherwise))


def _percent(c: str | Column) -> Column:
    """Text of a number that is a percentage already."""
    return F.concat(fixed_point(c, 1), F.lit("%"))


def _seconds(c: str, decimals: int = 1) -> Column:
    return F.concat(fixed_point(c, decimals), F.lit("s"))


def _side_by_side(
    df: DataFrame, by: str, columns: Sequence[str], metrics: dict[str, Column], row: str
) -> DataFrame:
    """One line per metric with a value for each of ``columns``, the values of ``by``."""
    entries = [
        F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), value.alias("value"))
        for i, (label, value) in enumerate(metrics.items())
    ]
    grid = (
        df.select(by, F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.i", "e.label")
        .pivot(by, list(columns))
        .agg(F.first("e.value"))
    )
    return _lines(grid, 1, F.col("i"), F.format_string(row, "label", *columns))


def _target_rank(targets: Sequence[str], column: str) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in targets]), F.col(column))


def _confusion_lines(confusions: DataFrame, section: int, arrow: str) -> DataFrame:
    row = fixed.CONFUSION_ROW.format(arrow=arrow)
    line = F.format_string(row, "true_species", "predicted_species", "times")
    name = F.concat_ws("|", "true_species", "predicted_species")
    return _lines(confusions, section, -F.col("times"), line, name)


def comparison_report(comparison: DataFrame, species: str) -> DataFrame:
    """Page for ``pipeline_comparison``: one line per metric, a column per pipeline."""
    spark = comparison.sparkSession
    values = [
        F.col("processed").cast("string"),
        F.col("localised").cast("string"),
        _or(pct("mean_confidence"), "n/a"),
        _or(fixed_point("mean_quality", 3), "n/a"),
        _seconds("elapsed_s"),
        _seconds("seconds_per_image"),
    ]
    metrics = dict(zip(fixed.COMPARISON_METRICS, values))
    rule = "=" * fixed.COMPARISON_RULE
    head = [
        rule,
        fixed.COMPARISON_TITLE.format(species=species),
        rule,
        "",
        fixed.COMPARISON_ROW % tuple(fixed.COMPARISON_HEADINGS),
        "-" * fixed.COMPARISON_RULE,
    ]
    return _page(
        _fixed_lines(spark, 0, head),
        _side_by_side(
            comparison, "pipeline", fixed.PIPELINE_ORDER, metrics, fixed.COMPARISON_ROW
        ),
        _fixed_lines(spark, 2, [rule, "", *fixed.COMPARISON_NOTES]),
    )


def evaluation_report(
    accuracy: DataFrame,
    by_species: DataFrame,
    confusions: DataFrame,
    targets: Sequence[str],
    source: str = "",
) -> DataFrame:
    """Page for the zero-shot evaluation; labels appear in target order.

    ``source`` is where the evaluation rows are stored.
    """
    spark = accuracy.sparkSession
    rule, thin = "=" * fixed.EVALUATION_RULE, "-" * fixed.EVALUATION_RULE
    values = [
        F.col("total").cast("string"),
        F.col("correct").cast("string"),
        _percent("accuracy_pct"),
    ]
    totals = [
        F.format_string(fixed.EVALUATION_TOTAL_ROW, F.lit(label), value)
        for label, value in zip(fixed.EVALUATION_TOTALS, values)
    ]
    total_lines = accuracy.select(F.posexplode(F.array(*totals)).alias("i", "line"))
    exact = F.col("correct") * 100.0 / F.col("images")
    flag = F.when(F.col("passed"), fixed.PASS_FLAG).otherwise(fixed.FAIL_FLAG)
    row = F.format_string(fixed.EVALUATION_ROW, "species", "images", "correct", _percent(exact))
    none = confusions.agg(F.count("*").alias("n")).filter("n = 0")
    head = [rule, fixed.EVALUATION_TITLE, rule, ""]
    table = ["", fixed.EVALUATION_ROW % tuple(fixed.EVALUATION_HEADINGS), thin]
    wrong = [rule, "", fixed.EVALUATION_CONFUSED, thin]
    shown = by_species.filter(F.col("species").isin(list(targets)))
    return _page(
        _fixed_lines(spark, 0, head),
        _lines(total_lines, 1, F.col("i"), F.col("line")),
        _fixed_lines(spark, 2, table),
        _lines(shown, 3, _target_rank(targets, "species"), F.concat_ws(" ", row, flag)),
        _fixed_lines(spark, 4, wrong),
        _confusion_lines(confusions, 5, "→"),
        _lines(none, 5, F.lit(0), F.lit(fixed.NO_CONFUSIONS)),
        _fixed_lines(spark, 6, ["", fixed.EVALUATION_SOURCE.format(path=source)]),
    )


def model_report(
    comparison: DataFrame, by_species: DataFrame, confusions: DataFrame, targets: Sequence[str]
) -> DataFrame:
    """Page for identification against localisation against both."""
    spark = comparison.sparkSession
    stages = ["identification", "localisation", "combined"]
    rule, thin = "=" * fixed.MODEL_RULE, "-" * fixed.MODEL_RULE
    values = [
        F.col("images").cast("string"),
        F.col("correct").cast("string"),
        _or(_percent("rate_pct"), "n/a"),
    ]
    if "elapsed_s" in comparison.columns:
        values += [_or(_seconds("elapsed_s"), "—"), _or(_seconds("seconds_per_image", 2), "—")]
    metrics = dict(zip(fixed.MODEL_METRICS, values))
    row = F.format_string(
        fixed.MODEL_SPECIES_ROW,
        "true_species",
        _percent("identification_pct"),
        _percent("localisation_pct"),
        _percent("combined_pct"),
        "images",
    )
    head = [
        rule,
        fixed.MODEL_TITLE,
        rule,
        "",
        fixed.MODEL_ROW % tuple(fixed.MODEL_HEADINGS),
        thin,
    ]
    table = ["", *fixed.MODEL_NOTES, "", fixed.MODEL_SPECIES_ROW % tuple(fixed.MODEL_SPECIES_HEADINGS), thin]
    shown = by_species.filter(F.col("true_species").isin(list(targets)))
    return _page(
        _fixed_lines(spark, 0, head),
        _side_by_side(comparison, "stage", stages, metrics, fixed.MODEL_ROW),
        _fixed_lines(spark, 2, table),
        _lines(shown, 3, _target_rank(targets, "true_species"), row),
        _fixed_lines(spark, 4, ["", fixed.MODEL_CONFUSED, thin]),
        _confusion_lines(confusions, 5, "->"),
        _fixed_lines(spark, 6, [rule]),
    )


def count_report(accuracy: DataFrame, species: str) -> DataFrame:
    """Page for counting accuracy, a line per pipeline in report order."""
    spark = accuracy.sparkSession
    rule = "=" * fixed.COUNT_RULE
    means = [_or(fixed_point(c, 1), "nan") for c in ("mean_count", "mean_gt", "mae")]
    row = F.format_string(fixed.COUNT_ROW, "pipeline", *means, _percent("exact_pct"))
    head = [
        rule,
        fixed.COUNT_TITLE.format(species=species),
        rule,
        "",
        fixed.COUNT_ROW % tuple(fixed.COUNT_HEADINGS),
        "-" * fixed.COUNT_RULE,
    ]
    notes = ["", *fixed.COUNT_NOTES, rule]
    return _page(
        _fixed_lines(spark, 0, head),
        _lines(accuracy, 1, _target_rank(fixed.PIPELINE_ORDER, "pipeline"), row, F.col("pipeline")),
        _fixed_lines(spark, 2, notes),
    )
