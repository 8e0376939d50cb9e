"""Name to query and name to SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.driver import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the views by name."""

    def register(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = views.with_views(sql)
        return function

    return register


def round4(c: str | Column) -> Column:
    """Rounds away what differs between engines that add in another order.

    The offset, also in the SQL, moves means that lie just on a tie off it.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.lit(1e-9) + c, 4)


def fixed_lines(**sections: list[str]) -> str:
    """SQL for the lines of a page that no data goes into; ``s0`` is section 0."""
    rows = [
        f"({name[1:]}, CAST({i} AS DOUBLE), '{line.replace(chr(39), chr(39) * 2)}')"
        for name, lines in sections.items()
        for i, line in enumerate(lines)
    ]
    return f"SELECT section, rank, text FROM (VALUES {', '.join(rows)}) f(section, rank, text)"
