"""Registered queries over the driver tables, with the SQL they are checked against."""

from spoorline.driver import (  # noqa: F401
    detection,
    evaluation,
    files,
    jobs,
    retrieval,
    sequences,
    summaries,
    truth,
)
from spoorline.driver.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
