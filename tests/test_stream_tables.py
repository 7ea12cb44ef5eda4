"""Stream queries over tables that are folders of parts, as a large copy has them."""

from __future__ import annotations

import shutil

import duckdb
import pytest

import __spark_entry__ as contract

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def parts(spark, tmp_path):
    """Every table in two parts or more, below the folder named as its file was."""
    for name in ("pages", "events", "documents"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(2).write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    return str(tmp_path / "in")


def test_ingest_stream_reads_a_table_in_parts(spark, parts):
    got, want = (sorted(map(tuple, contract.queries()["ingest_stream"](spark, folder).collect())) for folder in (parts, SMALL))
    assert got == want and len(want) > 0


def test_a_single_file_is_read_as_before(spark, tmp_path):
    (tmp_path / "one").mkdir()
    for name in ("pages", "documents"):
        shutil.copy(f"{SMALL}/{name}.parquet", tmp_path / "one")
    pages = duckdb.sql(f"SELECT count(*) FROM '{SMALL}/pages.parquet'").fetchall()[0][0]
    done = contract.queries()["ingest_stream"](spark, f"{tmp_path}/one/").where("stage IN ('embedded', 'failed')")
    assert done.select("document_id").distinct().count() == pages
