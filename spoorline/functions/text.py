"""Names, paths and number texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoorline import fixed_values as fixed


def _as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: str | Column, table: dict, default: Column) -> Column:
    """Value of a small fixed table, or ``default`` when the key is missing."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _as_column(c)), default)


def pretty_species(c: str | Column) -> Column:
    c = _as_column(c)
    return lookup(c, fixed.DISPLAY_NAMES, F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))


def concept_prompt(c: str | Column) -> Column:
    return lookup(c, fixed.CONCEPT_PROMPTS, _as_column(c))


def species_colour(c: str | Column) -> Column:
    """The overlay colour as ``blue,green,red``."""
    shown = {label: ",".join(map(str, colour)) for label, colour in fixed.SPECIES_COLOURS.items()}
    default = ",".join(map(str, fixed.DEFAULT_COLOUR))
    return lookup(F.lower(_as_column(c)), shown, F.lit(default))


def pipeline_label(c: str | Column) -> Column:
    labels = {name: shown["label"] for name, shown in fixed.PIPELINE_DISPLAY.items()}
    return lookup(c, labels, _as_column(c))


def pipeline_output(c: str | Column) -> Column:
    outputs = {name: shown["output"] for name, shown in fixed.PIPELINE_DISPLAY.items()}
    return lookup(c, outputs, F.lit(""))


def file_name(path: str | Column) -> Column:
    """Last part of a path, with either kind of separator."""
    return F.regexp_extract(_as_column(path), r"([^/\\]*)$", 1)


def file_stem(path: str | Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def round_exact(c: str | Column, decimals: int) -> Column:
    """A double rounded by its exact binary value, ties to even, up to 6 decimals.

    Spark's ``round`` works on the shortest decimal text and rounds half up, which
    differs for values such as 0.00015. Only the fraction is rounded: it is split into
    two parts that multiply without error, so the distance to the tie has the right
    sign. Whole part and rounded digits then give the nearest double: as a quotient of
    two whole doubles while these are exact, else as a sum, where a double's neighbours
    are too far apart for the last step to matter. Infinities and NaN stay.
    """
    given = _as_column(c).cast("double")
    x = F.abs(given)
    scale = F.lit(float(10**decimals))
    part = F.nanvl(x % F.lit(1.0), F.lit(0.0))
    whole = x - part
    head = part.cast("float").cast("double")
    scaled = part * scale
    below = scaled - scaled % F.lit(1.0)
    past_tie = ((head * scale - below) - F.lit(0.5)) + (part - head) * scale
    is_odd = (below if decimals else whole) % F.lit(2.0) == 1.0
    digits = below + ((past_tie > 0) | ((past_tie == 0) & is_odd)).cast("double")
    joined = F.when(x < 1e9, (whole * scale + digits) / scale).otherwise(whole + digits / scale)
    return F.signum(given) * joined


def fixed_point(c: str | Column, decimals: int) -> Column:
    """Number text with fixed decimals, rounded as ``round_exact`` does.

    All digits are those of the rounded value up to 15 significant ones.
    """
    c = _as_column(c)
    shown = F.format_string(f"%.{decimals}f", round_exact(c, decimals))
    # no text for a null; a condition around the text would keep Spark from sharing its
    # parts. The longest double takes 309 digits before the point.
    return F.left(shown, F.when(c.isNotNull(), F.lit(400)))


def pct(fraction: str | Column, decimals: int = 1) -> Column:
    """A fraction as percent text, such as ``12.5%``."""
    return F.concat(fixed_point(_as_column(fraction) * F.lit(100.0), decimals), F.lit("%"))


def round4(c: str | Column) -> Column:
    return round_exact(c, 4)


def detection_id(*parts: str | Column) -> Column:
    """Repeatable id of a detection: 16 hex characters of a SHA-256."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
