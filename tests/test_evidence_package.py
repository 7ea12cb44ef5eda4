from __future__ import annotations

from ledgerloom.operators import peers, planning as P
from ledgerloom.sources import universe as U

PLAN = "request_id string, request_type string, companies array<string>, retrieval_queries array<string>"
PLANS = [("a", "comparison", ["X", "Y", "Z"], ["q"]), ("b", "comparison", ["Y"], ["q"]), ("c", "factual_query", [], []), ("d", "comparison", ["Y", "NONE"], ["q"])]
LONG = [("X", "roe", 5.0), ("Y", "roe", 7.0), ("Z", "roe", 5.0), ("X", "pe_ratio", 12.0), ("Y", "pe_ratio", None), ("Z", "pe_ratio", 9.0)]


def _ranked(spark):
    plans = spark.createDataFrame(PLANS, PLAN)
    return plans, P.request_peers(plans, spark.createDataFrame(LONG, "ticker string, metric string, value double"))


def test_peers_of_a_request(spark):
    _, ranked = _ranked(spark)
    got = sorted((r.request_id, r.metric, r["rank"], r.ticker) for r in ranked.collect())
    assert got == [("a", "pe_ratio", 1, "Z"), ("a", "pe_ratio", 2, "X"), ("a", "roe", 1, "Y"), ("a", "roe", 2, "X"), ("a", "roe", 3, "Z"), ("d", "roe", 1, "Y")]


def test_trace_and_package(spark):
    plans, ranked = _ranked(spark)
    known = spark.createDataFrame([("X", 1.0, 2.0), ("Y", 3.0, 4.0)], "ticker string, current_price double, market_cap double")
    market = P.gather_market(plans, known)
    chunks = spark.createDataFrame([("a", 1, "t1"), ("a", 0, "t0"), ("b", 0, "t")], "request_id string, pos int, text string")
    news = P.gather_news(plans, spark.createDataFrame([("Y", 1, "n1"), ("Y", 2, "n2"), ("Y", 3, "n3")], "ticker string, pos int, title string"), 2)
    trace = P.execution_trace(plans, {"market_service": market, "retriever": chunks, "news_service": news, "peer_comparison": ranked})
    got = {(r.request_id, r.tool): (r.step, r.status, r["items"], r.errors) for r in trace.collect()}
    assert len(got) == 16
    assert got["a", "market_service"] == (0, "success", 2, 1) and got["d", "market_service"] == (0, "success", 1, 1)
    assert got["a", "retriever"] == (1, "success", 2, 0) and got["c", "retriever"] == (1, "skipped", 0, 0) and got["d", "retriever"] == (1, "success", 0, 0)
    assert got["b", "news_service"] == (2, "success", 2, 0) and got["b", "peer_comparison"] == (3, "skipped", 0, 0) and got["a", "peer_comparison"] == (3, "success", 5, 0)
    engine = P.run_engine(plans, spark.createDataFrame([("X", 3)], "ticker string, computed int"), spark.createDataFrame([("X", 50.0)], "ticker string, health double"))
    info = spark.createDataFrame([("X", "Ex", "tech")], "ticker string, name string, sector string")
    out = {r.request_id: r for r in P.assemble_evidence(plans, info, engine, market, chunks, news, ranked).collect()}
    assert [(p.metric, p["rank"], p.ticker) for p in out["a"].peer_comparison][:2] == [("pe_ratio", 1, "Z"), ("pe_ratio", 2, "X")]
    assert out["b"].peer_comparison == [] and out["c"].ticker == "UNKNOWN" and [c.text for c in out["a"].chunks] == ["t0", "t1"]
    assert "peer_comparison" not in P.assemble_evidence(plans, info, engine, market, chunks, news).columns


def test_failed_look_ups_are_unknown(spark):
    cik = spark.createDataFrame([("abc",)], "ticker string")
    rows = spark.createDataFrame([(1, " Abc", False), (2, "abc", True), (3, "x", None), (4, " ", False), (5, None, None)], "i int, ticker string, lost boolean")
    got = {r.i: r.exchange_group for r in U.exchange_route(rows, cik, failed="lost").collect()}
    assert got == {1: "us", 2: "unknown", 3: "in", 4: "unknown", 5: "unknown"}
    assert {r.i: r.exchange_group for r in U.exchange_route(rows, cik).collect()}[2] == "us"


def test_market_comparison(spark):
    market = spark.createDataFrame([("A", 0.0, 0, 0.0, 3.5), ("B", 2.5, 7, None, None)], "ticker string, price double, market_cap long, dividend_yield double, forward_pe double")
    got = [(r.ticker, r.metric, r.value) for r in peers.market_comparison(market, ["ticker"]).orderBy("ticker", "metric").collect()]
    assert got == [("A", "dividend_yield", None), ("A", "forward_pe", 3.5), ("A", "market_cap", None), ("A", "price", None),
                   ("B", "dividend_yield", None), ("B", "forward_pe", None), ("B", "market_cap", 7.0), ("B", "price", 2.5)]


def test_all_news_of_the_planned_companies(spark):
    plans = spark.createDataFrame(PLANS, PLAN)
    news = spark.createDataFrame([(t, i, f"{t}{i}") for t in ("X", "Y", "OTHER") for i in range(8)], "ticker string, pos int, title string")
    rows = P.gather_all_news(plans, news).collect()
    asked = {(r.request_id, r.pos, r.ticker) for r in rows if r.request_id is not None}
    assert asked == {("a", 0, "X"), ("a", 1, "Y"), ("b", 0, "Y"), ("d", 0, "Y")}
    assert sorted((r.ticker, r.news_pos, r.title) for r in rows if r.request_id is None) == [(t, i + 1, f"{t}{i}") for t in "XY" for i in range(8)]
