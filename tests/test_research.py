from __future__ import annotations

import pytest
import re

from pyspark.sql import functions as F

from ledgerloom.functions.numeric import plain_number
from ledgerloom.operators import evidence as E
from ledgerloom.operators import planning as P
from ledgerloom.operators import reports as R


@pytest.mark.parametrize("request_text, kind, companies", [
    ("Compare TCS and Infosys", "comparison", ["TCS", "INFY"]), ("What are the risks for Apple?", "risk_analysis", ["AAPL"]),
    ("Write a research report on Tesla", "investment_memo", ["TSLA"]), ("What is the ROE of WIPRO?", "factual_query", ["WIPRO"]),
    ("Tell me about HCL and the CEO of IBM", "company_analysis", ["HCLTECH", "HCL", "IBM"]), ("hello", "company_analysis", [])])
def test_plans(spark, request_text, kind, companies):
    r = P.create_plan(spark.createDataFrame([("r1", request_text)], "request_id string, request string")).first()
    assert (r.request_type, r.companies) == (kind, companies)
    n = {"comparison": 2, "risk_analysis": 4, "investment_memo": 5, "factual_query": 1, "company_analysis": 4}[kind]
    assert len(r.retrieval_queries) == n * len(companies)
    assert r.output_format == ("brief_answer" if kind == "factual_query" else "research_report")
    if companies:
        assert r.retrieval_queries[0].startswith(companies[0])


def test_sentences(spark):
    df = spark.createDataFrame([("**Bold** grew. *It* rose! lower stays\nNew line\n\nAnd? Yes",)], "c string")
    assert df.select(E.split_sentences("c").alias("s")).first().s == ["Bold grew.", "It rose! lower stays", "New line", "And?", "Yes"]


SECTION = "report_id int, section_key string, content string, confidence double"


def sections(spark):
    return spark.createDataFrame([
        (1, "executive_summary", "Revenue increased by 14% in 2025. Strong demand is good. Nothing. Figure 987654 is odd. See ref [3] at 555 units.", 0.9),
        (1, "valuation", "The quarterly dividend payments continued without change. Value was 31.25 overall.", None),
        (1, "appendix_x", "Revenue 1.", 0.5), (2, "valuation", "Short.", 0.2)], SECTION)


def test_claims_and_verdicts(spark):
    claims = E.extract_claims(sections(spark))
    texts = [r.text for r in claims.orderBy("section_no", "pos").collect()]
    assert texts == ["Revenue increased by 14% in 2025.", "Figure 987654 is odd.", "See ref [3] at 555 units.",
                     "The quarterly dividend payments continued without change.", "Value was 31.25 overall."]
    evidence = spark.createDataFrame([(1, 0, "Nothing alike"), (1, 1, "Sales grew 14 percent " + "x" * 300), (1, 40, "quarterly dividend payments were made")],
                                     "report_id int, pos int, text string")
    values = spark.createDataFrame([(1, 0, "31.25", "Financial engine: roe = 31.25%")], "report_id int, value_pos int, printed string, label string")
    v = E.verify_claims(claims, evidence, values)
    got = {r.text: (r.verification, r.supporting_evidence) for r in v.collect()}
    assert got[texts[0]][0] == "verified" and got[texts[0]][1].startswith("Sales grew 14") and len(got[texts[0]][1]) == 200
    assert got[texts[1]] == ("unverified", "")
    assert got[texts[2]] == ("verified", "Citation present (reference verified)")
    assert got[texts[3]] == ("verified", "quarterly dividend payments were made")
    assert got[texts[4]] == ("verified", "Financial engine: roe = 31.25%")
    rate = {r.report_id: (r.total_claims, r.verified, r.unverified, r.verification_rate) for r in E.verification_summary(sections(spark), v).collect()}
    assert rate == {1: (5, 4, 1, 0.8), 2: (0, 0, 0, 1.0)}
    revised = {(r.report_id, r.section_key): r for r in E.revise_report(sections(spark), v).collect()}
    assert revised[1, "executive_summary"].confidence == 0.8
    assert "1 statement(s) in this section" in revised[1, "executive_summary"].content
    assert revised[1, "valuation"].confidence is None and revised[1, "valuation"].revision_notes == "1 claims revised across 1 sections."
    assert revised[2, "valuation"].revision_notes == "All claims verified — no revision needed."


def test_number_tokens_keep_the_dot(spark):
    df = spark.createDataFrame([("In 2025. and [1] 3.5% 2025",)], "t string")
    assert df.select(E.number_tokens("t").alias("n")).first().n == ["2025.", "1", "3.5", "2025"]


def test_buckets(spark):
    rows = [(0, "Revenue rose", None), (1, "nothing here", "Risk Factors"), (2, "plain AI words", None)]
    got = {}
    for r in E.evidence_buckets(spark.createDataFrame(rows, "pos int, text string, section string")).collect():
        got.setdefault(r.pos, set()).add(r.bucket)
    assert got == {0: {"business_overview", "financial_analysis"}, 1: {"risk_analysis"}, 2: {"other"}}


@pytest.mark.parametrize("metrics, n, news, expected", [(True, 3, True, 1.0), (True, 1, False, 0.7), (False, 0, False, 0.0), (True, 5, False, 0.85)])
def test_section_confidence(spark, metrics, n, news, expected):
    assert spark.range(1).select(E.section_confidence(F.lit(metrics), F.lit(n), F.lit(news)).alias("c")).first().c == expected


def test_formats(spark):
    chunks = spark.createDataFrame([("r", 1, "Second", None, None, None, 0.5), ("r", 0, " First ", "Risk", 4, 6, 0.876)],
                                   "request_id string, pos int, text string, section string, page_start int, page_end int, score double")
    assert E.format_evidence(chunks).first().text == (
        "  [1] (Risk, Pages 4–6, relevance: 0.88)\n      First\n\n  [2] (Unknown source, relevance: 0.50)\n      Second\n")
    news = spark.createDataFrame([("r", i, f"T{i}", "d", "s" * 300 if i == 0 else "") for i in range(12)], "request_id string, pos int, title string, date string, summary string")
    for limit, width in ((None, None), (10, 200)):
        lines = E.format_news(news, limit=limit, width=width).first().text.split("\n")
        assert lines[0] == "  - T0 (d)" and lines[1] == "    " + "s" * (width or 300) and len(lines) == (limit or 12) + 1


def test_plain_numbers(spark):
    df = spark.createDataFrame([(25.0,), (31.25,), (1.5e12,), (0.0005,), (0.0,), (-12345678.5,)], "d double")
    assert [r.p for r in df.select(plain_number("d").alias("p")).collect()] == ["25.0", "31.25", "1500000000000.0", "0.0005", "0.0", "-12345678.5"]


def test_layout_and_export(spark):
    rows = R.build_12_sections(sections(spark))
    one = {r.id: r for r in rows.where("report_id = 1").collect()}
    assert len(one) == 12 and one[1].confidence == 0.9 and one[2].content == "" and one[2].confidence == 0.0 and one[5].confidence is None
    heads = spark.createDataFrame([(1, "Acme", "ACM", "now"), (2, None, None, None)], "report_id int, company string, ticker string, generated_at string")
    cites = spark.createDataFrame([(1, 2, "S2", "p2"), (1, 1, None, None)], "report_id int, ref int, source string, text_preview string")
    text = {r.report_id: r.markdown for r in R.report_markdown(rows, heads, cites).collect()}
    assert text[1].startswith("# Equity Research Report: Acme (ACM)\n\n**Generated At:** now\n\n---\n\n## Executive Summary\n\nRevenue")
    assert "1. **Unknown**: \n2. **S2**: p2\n\n## Appendix" in text[1]
    assert text[2].startswith("# Equity Research Report: Company (TICKER)")
    assert '"ticker":"ACM"' in R.report_json(rows, heads).where("report_id = 1").first().report_json


def test_versions(spark):
    schema = "user int, ticker string, report_id string, created_at int"
    old = spark.createDataFrame([(1, "A", "x", 1), (1, "A", "y", 2)], schema)
    new = spark.createDataFrame([(1, "A", "z", 9), (1, "A", "w", 5), (2, "A", "v", 1)], schema)
    v = R.next_versions(old, new, [F.col("created_at")])
    assert {r.report_id: r.version for r in v.collect()} == {"w": 3, "z": 4, "v": 1}
    assert {(r.user, r.report_id) for r in R.latest_report(v).collect()} == {(1, "z"), (2, "v")}
    assert [r.version for r in R.report_versions(v, 1, "a").collect()] == [4, 3]


def test_support_equals_a_search_through_all_chunks(spark):
    import random
    import re
    rng = random.Random(2)
    words = [f"word{i}" for i in range(12)] + ["of", "the", "Über", "PROFIT", "profit"]
    text = lambda n: " ".join(rng.choice(words) if rng.random() < 0.97 else str(rng.randrange(40) / 2) for _ in range(n))
    claims = [(r, s, p, text(rng.randrange(1, 9))) for r in range(4) for s in range(2) for p in range(12)] + [(9, 0, 0, "word1 word2 word3"), (0, 5, 5, "")]
    chunks = [(r, 2 * p, text(rng.randrange(1, 12))) for r in range(3) for p in range(40)] + [(1, 1000, None)]

    def tokens(t):
        return set(re.findall(r"\d+\.?\d*", t)), {w for w in t.lower().split() if len(w) > 3}

    want = {}
    for r, s, p, t in claims:
        n, w = tokens(t)
        hits = [(at, c) for q, at, c in sorted(chunks, key=lambda x: x[1]) if q == r and c and (n & tokens(c)[0] or len(w & tokens(c)[1]) >= 3)]
        want[r, s, p] = hits[0][1][:200] if hits else None
    got = E.claim_evidence_join(spark.createDataFrame(claims, "report_id int, section_no int, pos int, text string"), spark.createDataFrame(chunks, "report_id int, pos int, text string"))
    assert {(r.report_id, r.section_no, r.pos): r.chunk_snippet for r in got.collect()} == want
    assert len({v for v in want.values() if v}) > 5


def test_a_report_with_many_chunks_is_spread_by_its_tokens(spark):
    claims = spark.range(40).selectExpr("1 AS report_id", "cast(id as int) AS section_no", "0 AS pos", "concat('alpha', id % 9, ' beta', id % 7, ' gamma', id, ' delta') AS text")
    chunks = spark.range(20000).selectExpr("1 AS report_id", "cast(id as int) AS pos", "concat('delta beta', id % 7, ' gamma', id % 50, ' other words alpha', id % 9) AS text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = E.claim_evidence_join(claims, chunks)
        assert found.where("chunk_snippet IS NOT NULL").count() == 40
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(report_id" in plan and "hashpartitioning(report_id#" not in re.sub(r"hashpartitioning\(report_id#\d+L?, (token|at|section_no|pos)", "", plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_claims_are_made_once(spark, tmp_path):
    path = str(tmp_path / "given_claims")
    spark.createDataFrame([(1, 1, 0, "alpha beta gamma 12 delta")], "report_id int, section_no int, pos int, text string").write.parquet(path)
    chunks = spark.createDataFrame([(1, 0, "\x1cAlpha  gamma DELTA\x1f")], "report_id int, pos int, text string")
    found = E.claim_evidence_join(spark.read.parquet(path), chunks)
    assert not any("given_claims" in f for f in found.inputFiles())
    assert [tuple(r) for r in found.collect()] == [(1, 1, 0, "alpha beta gamma 12 delta", "\x1cAlpha  gamma DELTA\x1f")]
