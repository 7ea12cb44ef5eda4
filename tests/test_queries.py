"""Every registered query runs, and those with SQL give the same rows as DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from ledgerloom import catalog
from ledgerloom.tables import NAMES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def test_registry():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 200


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE:
        return
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want
