"""Every registered query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from loomtok.plans.reference import ORACLE_SQL, QUERIES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="session")
def views(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f[:-8]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, views, data, name):
    df = QUERIES[name](spark, data)
    rows = [r.asDict() for r in df.collect()]
    assert rows
    if name not in ORACLE_SQL:
        return
    other = views.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(other.columns)
    assert {c: KINDS[k] for c, k in df.dtypes} == dict(zip(other.columns, map(str, other.types), strict=True))
    there = [dict(zip(other.columns, x, strict=True)) for x in other.fetchall()]
    assert sorted(str([x[c] for c in cols]) for x in rows) == sorted(str([x[c] for c in cols]) for x in there)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
