"""The SQL of the corpus queries gives the same rows as Spark."""

from __future__ import annotations

import duckdb
import pytest

from ledgerloom.llm import catalog
from ledgerloom.tables import NAMES
from tests.llm.conftest import SF


def test_registry():
    assert [n.split("_")[0] for n in catalog.queries()] == [f"op{n}" for n in range(1, 14)] + ["pipeline"]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(repr(r[c]) for c in columns) for r in df.collect()) == want
