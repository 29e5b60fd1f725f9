"""Every SQL-checkable registered query against its DuckDB oracle
(sf0.001): same column names, row count and order-insensitive values."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tidewatch.sources.tables import TABLES

SQL = E.oracle_sql()
# Spark simple type → DuckDB type name of the same values
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "array<string>": "VARCHAR[]"}


def _norm(v):
    if v is None:
        return ("null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, sf, duck, name):
    df = E.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    duck_types = dict(zip(ocols, [str(t) for t in duck.sql(SQL[name]).types]))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == duck_types
    assert len(rows) == len(orows)
    assert _canon(rows, df.columns) == _canon(orows, ocols)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"attack_cat", "total", "pct"}
    assert df.count() > 0
