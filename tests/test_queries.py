"""Every registered query against its SQL twin over the smallest tables; rows-only queries against their invariants."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from claimloom import registry

TABLES = os.environ.get("CLAIMLOOM_TABLES", "/root/testdata/sf0.001")
registry.load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(value):
    if hasattr(value, "__len__") and not isinstance(value, str):
        return str([plain(v) for v in value])
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine, theirs = registry.QUERIES[name](spark, TABLES).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs_twice_alike(spark, name):
    one = registry.QUERIES[name](spark, TABLES)
    assert len(set(one.columns)) == len(one.columns)
    assert rows(one.toPandas()) == rows(registry.QUERIES[name](spark, TABLES).toPandas())
