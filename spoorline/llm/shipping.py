"""Queries that send this package to the executors before they run."""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession

from spoorline.shipping import ship

__all__ = ["ship", "shipped"]


def shipped(function):
    """A function whose first argument is a session, run after ``ship``."""

    @functools.wraps(function)
    def run(spark: SparkSession, *rest):
        ship(spark)
        return function(spark, *rest)

    return run
