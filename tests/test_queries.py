"""Every registered query with SQL gives the rows that DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df):
    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, float):
            return round(x, 5)
        return bool(x) if type(x).__name__ in ("bool", "bool_") else int(x) if hasattr(x, "__index__") else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = rows(catalog.QUERIES[name](spark, FOLDER).toPandas())
    if name in catalog.ORACLES:
        assert got == rows(duck.execute(catalog.ORACLES[name]).df())
    else:
        assert got[1]


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
