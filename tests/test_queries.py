"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from vecloom.plans import engine, general

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = {**engine.QUERIES, **general.QUERIES}, {**engine.ORACLES, **general.ORACLES}
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    # the tree by recursive SQL takes seconds: once is enough
    c.execute(f"create table _mst as with recursive {engine._prim()} select * from mst")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    kept = f"{engine._ID}, mst AS (SELECT * FROM _mst)"
    rel = duck.sql(ORACLES[name].replace(engine._prim(), kept))
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
