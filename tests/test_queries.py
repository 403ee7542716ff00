"""Every query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from quire import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(columns, data):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return round(float(v), 6) if isinstance(v, float) else str(v)

    return sorted((tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    want = duck.sql(Q.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_others_have_rows(spark, name):
    """On tables that are large enough for trends and bursts."""
    assert Q.QUERIES[name](spark, SF.replace("0.001", "0.01")).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(Q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
