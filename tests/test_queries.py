"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as contract
from spoorline.driver import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "events embeddings lineitem orders documents benchmark labels".split()



@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def comparable(value):
    if isinstance(value, (float, Decimal)):
        return "nan" if math.isnan(value) else repr(round(float(value), 6) + 0.0)
    return f"{type(value).__name__}:{value}"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, oracle, name):
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    ours = sorted(tuple(comparable(r[c]) for c in columns) for r in found.collect())
    assert name in ORACLES
    result = oracle.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(comparable(r[i]) for i in at) for r in result.fetchall())
    assert ours == theirs
    assert ours


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
