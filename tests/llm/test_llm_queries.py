"""Registered queries against DuckDB on the same tables."""

import duckdb
import pytest

from spoorline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark labels".split()


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute(ORACLES[name])
    columns = sorted(c[0] for c in con.description)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == columns
    assert plain(found.select(columns).collect()) == plain(expected)


def test_every_operator_has_a_query():
    missing = [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in QUERIES)]
    assert not missing
