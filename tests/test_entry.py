"""The driver's contract: names, columns, and the two engines' rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from docfold.plans.oracle import ORACLE
from docfold.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the test tables are not here")


def shown(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(shown, value))
    return round(float(value), 6) if isinstance(value, float) else value


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_equal_the_oracle(spark, tables, name):
    df = QUERIES[name](spark, SMALL)
    want = tables.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    left = sorted((shown([r[c] for c in columns]) for r in df.collect()), key=str)
    right = sorted((shown([r[i] for i in at]) for r in want.fetchall()), key=str)
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_oracle_give_rows(spark, name):
    assert QUERIES[name](spark, SMALL).collect()
