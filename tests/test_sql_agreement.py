"""Rows on which queries and their SQL once differed: ties, roundings, texts whose marks cancel each other out."""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from ledgerloom.catalog.bindings import financials
from ledgerloom.catalog.finance import round_sql
from ledgerloom.streaming import jobs

SMALL = "/root/testdata/sf0.001"
NUMBERS = [123456789.12499999, -123456789.12499999, 1.005, 2.675, -0.125, 64.05, 1e-7, 9.9e30, 0.0, 12345678912.495]


@pytest.mark.parametrize("places", [1, 2, 4])
def test_rounding_is_by_written_digits(spark, places):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in NUMBERS], "x double").select(F.round("x", places)).collect()]
    rows = ", ".join(f"({i}, {x!r}::DOUBLE)" for i, x in enumerate(NUMBERS))
    want = duckdb.sql(f"SELECT {round_sql('x', places)} FROM (VALUES {rows}) t(i, x) ORDER BY i").fetchall()
    assert got == [w[0] for w in want]


@pytest.mark.parametrize("name", ["chart_series", "financial_health_score"])
def test_sql_states_the_rounding(name):
    assert "DECIMAL(38, 20)" in contract.oracle_sql()[name]


def both(spark, tmp_path, name, **tables):
    """The query and its SQL over tables of which some are given."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.repartition(2).write.parquet(str(tmp_path / "in" / f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/in/{table}.parquet/*.parquet')")
    df = contract.queries()[name](spark, str(tmp_path / "in"))
    con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in con.description]
    return sorted(map(tuple, df.select(*columns).collect())), sorted(con.fetchall())


def test_quotes_of_one_time_and_within_a_second(spark, tmp_path):
    t = dt.datetime(2024, 1, 30, 12, 0, 0)
    rows = [(i, t, 7, "view", float(i * 37 % 50), "{}") for i in range(50)]
    rows += [(100 + i, t + dt.timedelta(microseconds=u), 8 + i, "view", 1.0, "{}") for i, u in enumerate((-1, 0, 1, 500_000))]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    got, want = both(spark, tmp_path, "quote_cache_stream", events=events)
    assert got == want and {(r[0], r[1], r[-1]) for r in got} >= {("U7", float(49 * 37 % 50), False), ("U9", 1.0, False), ("U10", 1.0, True), ("U11", 1.0, True)}


def test_latest_value_of_one_time_is_the_largest(spark):
    rows = [("A", 1, v) for v in (3.0, 9.0, 5.0)]
    assert jobs.latest_values(spark.createDataFrame(rows, "ticker string, ts long, price double"), "ticker", "ts", "price").first().value == 9.0


def cancelling():
    """Two words of one slot and different signs."""
    marks = {}
    for letters in itertools.product("abcdefgh", repeat=3):
        word = "".join(letters)
        mark = hashlib.md5(word.encode()).digest()[0] % 128
        if (mark + 64) % 128 in marks:
            return f"{word} {marks[(mark + 64) % 128]}"
        marks[mark] = word


def test_embed_chunks_texts_without_a_vector(spark, tmp_path):
    texts = [cancelling(), "äé", "— …", "", None, "plain words here", "plain words here"]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got, want = both(spark, tmp_path, "embed_chunks", documents=docs)
    assert got == want == [("src1", 7, 3, 0, 4)]


@pytest.mark.parametrize("name", ["embed_documents_job", "ingest_journal"])
def test_files_without_a_vector(spark, tmp_path, name):
    body = "<html><body><p>{}</p></body></html>".format
    texts = [body(cancelling()), body("plain words here"), body("— …"), "", None, body("äé"), body("\n".join(f"Revenue of segment {i} grew by a margin." for i in range(60)))]
    rows = [(i * 10 + last, "u", t) for i, t in enumerate(texts) for last in (0, 1, 4, 7)]
    docs = spark.createDataFrame([(1, "t", "en", "src1", 1)], "doc_id long, text string, lang string, source string, n_chars int")
    got, want = both(spark, tmp_path, name, pages=spark.createDataFrame(rows, "page_id long, url string, html string"), documents=docs)
    outcome = {r[0]: r[1] for r in got}
    assert got == want and [outcome[f"P{i * 10 + 4}"] for i in range(len(texts))] == ["failed", "embedded", "failed", "failed", "failed", "embedded", "embedded"]


def test_chart_series_gives_every_point_of_all_series(spark):
    got = {r.company: r for r in contract.queries()["chart_series"](spark, SMALL).collect()}
    fin = financials(spark, SMALL).collect()
    assert {c: r.labels for c, r in got.items()} == {c: ",".join(str(f.year) for f in sorted(fin, key=lambda f: f.year) if f.company == c) for c in {f.company for f in fin}}
    points = {(c, year): i for c, r in got.items() for i, year in enumerate(r.labels.split(","))}
    for f in fin:
        r, i = got[f.company], points[f.company, str(f.year)]
        want = {"op_margin": f.operating_income / f.revenue * 1e4, "operating_cash_flow": f.operating_cash_flow * 100,
                "free_cash_flow": (f.operating_cash_flow - abs(f.capital_expenditure or 0)) * 100, "revenue": f.revenue * 100}
        assert all(abs(int(r[name].split(",")[i]) - v) <= 0.51 for name, v in want.items())
        assert all(sum(map(int, r[name].split(","))) == r[f"{name}_total"] for name in (*want, "net_margin", "roe"))
