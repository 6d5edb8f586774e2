"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tidegrid.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(cols, data):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted(tuple(value(r[k]) for k in at) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    found = duck.sql(catalog.ORACLES[name])
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {c: KINDS.get(str(t), str(t)) for c, t in zip(found.columns, found.types)}
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
