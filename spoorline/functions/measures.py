"""Verdicts, counts and rates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorline import fixed_values as fixed
from spoorline.functions.text import lookup


def _as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def correct_label(truth: str | Column, species: str | Column) -> Column:
    """``correct``, ``incorrect``, or ``unknown`` when there is no truth."""
    truth, species = _as_column(truth), _as_column(species)
    unknown = truth.isNull() | (truth == fixed.UNKNOWN)
    return (
        F.when(truth == species, fixed.CORRECT)
        .when(unknown, fixed.UNKNOWN)
        .otherwise(fixed.INCORRECT)
    )


def is_correct(verdict: str | Column) -> Column:
    """Boolean form of a verdict text; anything but ``correct`` is false."""
    return F.coalesce(F.lower(_as_column(verdict)) == fixed.CORRECT, F.lit(False))


def is_localised(location: str | Column) -> Column:
    """True when the location text is none of the empty ones."""
    return ~F.coalesce(_as_column(location), F.lit("")).isin(fixed.EMPTY_LOCATIONS)


def mask_localised(has_mask: str | Column, quality: str | Column) -> Column:
    """True when a mask exists and its quality is above zero."""
    return F.coalesce(_as_column(has_mask) & (_as_column(quality) > 0), F.lit(False))


def count_midpoint(label: str | Column) -> Column:
    """Number for a count label; unknown or missing labels give 1."""
    return lookup(
        F.coalesce(_as_column(label), F.lit("")),
        fixed.COUNT_NUMBERS,
        F.lit(fixed.DEFAULT_COUNT_NUMBER),
    )


def count_error(predicted: str | Column, truth: str | Column) -> Column:
    return F.abs(_as_column(predicted) - _as_column(truth)).cast("double")


def exact_match(predicted: str | Column, truth: str | Column) -> Column:
    """Equality in which a missing side counts as not equal."""
    return F.coalesce(_as_column(predicted) == _as_column(truth), F.lit(False))


def rate_pct(part: Column, whole: Column) -> Column:
    """Percent, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def mean_flag(flag: str | Column) -> Column:
    """Share of true values as an aggregate."""
    return F.avg(_as_column(flag).cast("double"))


def per_image_seconds(elapsed: Column, images: Column) -> Column:
    return elapsed / F.greatest(images, F.lit(1))


def social_structure(instance_count: str | Column) -> Column:
    """Group size class; null when no animal was counted."""
    n = _as_column(instance_count)
    return (
        F.when(n >= 6, "large herd").when(n >= 2, "small group").when(n == 1, "solitary")
    )
