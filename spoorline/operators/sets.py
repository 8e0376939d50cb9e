"""Unions."""

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame

from spoorline.operators.ranking import head_per_species


def union_pipelines(frames: Iterable[DataFrame | None]) -> DataFrame:
    """All rows of the given frames by column name; absent columns become null."""
    present = [f for f in frames if f is not None]
    if not present:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def concat_species(
    images: DataFrame, species: list[str], n: int | None = None, seq: str = "seq"
) -> DataFrame:
    """The images of the listed labels, at most ``n`` of each."""
    return head_per_species(images, n, seq, species)
