from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerloom.operators import registry as G
from ledgerloom.sources import documents as D
from ledgerloom.sources import filings as S
from ledgerloom.sources import market as M
from ledgerloom.sources import universe as U


def test_landing_folder(spark, tmp_path):
    for name, body in {"a.pdf": b"%PDF-1.7", "b.HTM": b"<p>x</p>", "c.json": b"{}", "d": b"  <html>", "e": b"[1]", "f.txt": b"words", "g.html": b"", "h": b"%PDF"}.items():
        (tmp_path / name).write_bytes(body)
    files = D.read_landing(spark, str(tmp_path))
    expected = files.select("path").unionByName(spark.createDataFrame([(f"file:{tmp_path}/g.html",)], "path string"))
    got = {r.path.rsplit("/", 1)[1]: (r.file_type, r.success) for r in D.scan_documents(files, expected).collect()}
    assert got == {"a.pdf": ("pdf", True), "b.HTM": ("html", True), "c.json": ("json", True), "d": ("html", True), "e": ("json", True),
                   "f.txt": (None, False), "g.html": (None, False), "h": ("pdf", True)}


def test_html_pages(spark):
    html = "<html><head><title>T &amp; x</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body><p>One<br>two</p><!-- c --> &copy; <b> three </b></body></html>"
    df = spark.createDataFrame([("d", html), ("e", "<p>" + "</p><p>".join("y" * 999 for _ in range(9)) + "</p>"), ("f", " ")], "document_id string, html string")
    got = {}
    for r in D.html_to_pages(df, ["document_id"]).orderBy("document_id", "page").collect():
        got.setdefault(r.document_id, []).append(r.text)
    assert got["d"] == ["T & x\nOne\ntwo\n©\nthree"]
    assert [len(p) for p in got["e"]] == [3999, 3999, 999] and "f" not in got


def test_json_text(spark):
    docs = ['{"period": "2024-03-31", "total_revenue": 1234567.5, "ebitda 2x_r&d": 7, "note": "as is", "none": null, "flag": true}', '[{"a": 1}, 2]']
    got = [r.t for r in spark.createDataFrame([(d,) for d in docs], "j string").select(D.json_statement_to_text("j").alias("t")).collect()]
    assert got[0] == "Period: 2024-03-31\nTotal Revenue: 1,234,567.50\nEbitda 2X R&D: 7.00\nNote: as is\nFlag: 1.00"
    assert '"a"' in got[1]


def test_market_rules(spark):
    raw = spark.createDataFrame([(" infy ", '{"currentPrice": 0, "regularMarketPrice": 5, "trailingPE": "NaN", "volume": 0, "regularMarketVolume": 9, "shortName": "Info"}'), ("x", "{}")], "ticker string, info string")
    info = M.parse_info(raw)
    snap = {r.ticker: r for r in M.market_snapshot(info).collect()}
    assert (snap["INFY"].price.current, snap["INFY"].multiples.pe_ratio, snap["INFY"].trading.volume) == (5.0, None, 9)
    assert snap["X"].price.current is None
    prof = {r.ticker: r for r in M.company_profile(info).collect()}
    assert (prof["INFY"].company_name, prof["X"].company_name, prof["X"].sector) == ("Info", "Unknown", "N/A")


def test_chart_quote(spark):
    doc = '{"chart":{"result":[{"meta":{"symbol":"TCS.NS","regularMarketPrice":110,"regularMarketTime":1700000000},"indicators":{"quote":[{"close":[null,%s]}]}}]}}'
    rows = [(doc % ",".join(str(i) for i in range(1, 101)),), (doc.replace('"regularMarketPrice":110', '"regularMarketPrice":null') % "1",), ('{"chart":{"result":[]}}',)]
    got = M.chart_quote(spark.createDataFrame(rows, "chart_json string")).collect()
    assert len(got) == 1
    q = got[0]
    assert (q.name, q.exchange, q.market, q.previousClose, q.change) == ("Tata Consultancy Services", "NSE", "IN", 99.0, 11.0)
    assert q.spark == [float(i) for i in range(41, 101)] and q.asOf == "2023-11-14T22:13:20Z"


def test_ticker_rules(spark):
    rows = [("TCS.NS", None), ("abc", "NSE"), ("ABC", "NYSE"), ("Apple", None), ("A1", None), ("TOOLONGNAME", None), ("BRK.B", "NYQ"), ("BRK.B", None)]
    df = spark.createDataFrame(rows, "t string, e string")
    assert [r.m for r in df.select(U.infer_market("t", "e").alias("m")).collect()] == ["IN", "IN", "US", "US", "OTHER", "OTHER", "US", "OTHER"]
    bad = spark.createDataFrame([("ok-1",), ("",), ("a b",), ("x" * 25,), ("é",)], "t string")
    assert [r.v for r in bad.select(U.validate_ticker("t").alias("v")).collect()] == ["OK-1", None, None, None, None]


def test_names(spark):
    df = spark.createDataFrame([("R&D: Q1 / plan--x", "\\abc_0123456789012345.PDF.pdf", "2024-05-06T10:00")], "h string, a string, d string")
    r = df.select(S.slug("h").alias("s"), S.clean_attachment_name("a").alias("a"), S.unique_file_name("d", "h", S.clean_attachment_name("a")).alias("f"),
                  S.document_id(F.lit("tcs"), F.lit("annual_report"), F.lit(2024), F.lit(None).cast("string"), F.lit("bse")).alias("i"), S.quarter_of("d").alias("q"),
                  S.slug(F.lit("&&&".replace("&", "!"))).alias("e")).first()
    assert r.asDict() == {"s": "RandD-Q1-plan-x", "a": "abc_0123456789012345.pdf", "f": "2024-05-06_RandD-Q1-plan-x_012345678901.pdf",
                          "i": "TCS_annual_report_2024_bse", "q": "Q2", "e": "file"}


def walk(annual, news, payload, as_of, a_limit, q_limit, n_limit, n_days):
    """The choice for one company, row by row."""
    out, seen = [], set()
    years = {}
    for pos, year, att in annual:
        years[str(year)] = att
    for y in sorted(years, reverse=True)[:a_limit]:
        if years[y]:
            seen.add(years[y])
            out.append(("annual_reports", years[y], years[y] in payload))
    for kind, limit, days in (("quarterly_reports", q_limit, 900), ("announcements", n_limit, n_days)):
        saved = 0
        for pos, on, category, title, flag, att in news:
            if on < as_of - dt.timedelta(days=days):
                continue
            if kind == "quarterly_reports" and category != "Result":
                continue
            if kind == "announcements" and (category.lower() == "result" or ("annual report" in title.lower() and "update" in category.lower())):
                continue
            if saved >= limit or flag != "1" or not att or att in seen:
                continue
            seen.add(att)
            out.append((kind, att, att in payload))
            saved += att in payload
    return sorted(out)


def test_select_filings_equals_a_walk(spark):
    r = random.Random(11)
    as_of = dt.date(2024, 6, 30)
    annual, news, payload, want = [], [], [], {}
    for scrip in range(40):
        atts = [f"F{i}.pdf" for i in range(14)]
        have = {a for a in atts if r.random() < 0.6}
        a = [(i, r.randrange(2018, 2025), r.choice([*atts, ""])) for i in range(r.randrange(0, 9))]
        n = [(i, as_of - dt.timedelta(days=r.randrange(0, 1200)), r.choice(["Result", "Company Update", "General", "result"]),
              r.choice(["Annual report sent", "Board met"]), r.choice("1110"), r.choice([*atts, ""])) for i in range(r.randrange(0, 40))]
        annual += [(scrip, *x) for x in a]
        news += [(scrip, i, on, str(i), t, None, c, "Sub", att, flag, str(on), "", "") for i, on, c, t, flag, att in n]
        payload += [(scrip, x, 900) for x in have]
        want[scrip] = walk(a, n, have, as_of, 2, 2, 3, 200)
    got = {}
    chosen = S.select_filings(
        spark.createDataFrame(annual, "scrip int, pos int, year int, file_name string"),
        spark.createDataFrame(news, "scrip int, pos int, filed_on date, NEWSID string, HEADLINE string, NEWSSUB string, CATEGORYNAME string, SUBCATNAME string, "
                                    "ATTACHMENTNAME string, PDFFLAG string, DissemDT string, DT_TM string, NEWS_DT string"),
        spark.createDataFrame(payload, "scrip int, attachment string, bytes long"), as_of, 2, 2, 3, 200)
    for row in chosen.collect():
        got.setdefault(row.scrip, []).append((row.kind, row.attachment, row.saved))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_registry(spark):
    schema = "document_id string, ticker string, company_name string, doc_type string, title string, year int, quarter string, file_path string, file_size long, source string, source_url string, checksum_sha256 string, processing_status string, updated_at string, pos int"

    def up(i, path, size, status, pos, title="t"):
        return (i, "tcs", "Tata", "annual_report", title, 2024, None, path, size, "bse", None, None, status, f"day{pos}", pos)

    first = spark.createDataFrame([up("a", "p1", 10, "downloaded", 1), up("a", "", 0, "verified", 2, "later")], schema)
    empty = first.drop("pos").withColumn("download_date", F.col("updated_at")).select(*G.REGISTRY_COLUMNS).limit(0)
    one = G.registry_upsert(empty, first)
    r = one.first()
    assert (r.ticker, r.title, r.file_path, r.file_size, r.processing_status, r.updated_at, r.download_date) == ("TCS", "t", "p1", 10, "verified", "day2", "day1")
    two = G.registry_upsert(one, spark.createDataFrame([up("a", "p2", None, "failed", 3, "new"), up("b", "p3", 5, "downloaded", 4)], schema))
    got = {r.document_id: r for r in two.collect()}
    assert (got["a"].title, got["a"].file_path, got["a"].file_size, got["a"].processing_status) == ("t", "p2", 10, "failed")
    files = spark.createDataFrame([("p2", 4), ("p3", 0)], "path string, length long")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "document_id string")
    assert [r.document_id for r in G.registry_exists(ids, two, files).collect()] == ["a"]
    assert sorted(r.document_id for r in G.registry_exists(ids, two, files, False).collect()) == ["b", "c"]
    listed = G.list_documents(two, " tcs", year=0).collect()
    assert {(x.company, x.total_documents) for x in listed} == {("Tata", 2)}


def test_every_look_back_at_once(spark):
    days = ["2024-06-30", "2024-05-31", "2024-05-30", "2024-03-30", "2023-12-29", "2019-06-30", "2010-01-01"]
    bars = spark.createDataFrame([("A", dt.date.fromisoformat(d), 1.0 * i, 2.0 * i, 0.5 * i, 1.5 * i, i) for i, d in enumerate(days, 1)]
                                 + [("B", dt.date(2015, 1, 1), 1.0, 1.0, 1.0, 1.0, 1)], "ticker string, date date, open double, high double, low double, close double, volume long")
    got = {(r.ticker, r.period): (r["count"], str(r.first_date), r.first_open, r.last_close) for r in M.price_windows(bars).collect()}
    assert got == {("A", "1mo"): (3, "2024-05-30", 3.0, 1.5), ("A", "3mo"): (4, "2024-03-30", 4.0, 1.5), ("A", "6mo"): (4, "2024-03-30", 4.0, 1.5),
                   ("A", "1y"): (5, "2023-12-29", 5.0, 1.5), ("A", "5y"): (6, "2019-06-30", 6.0, 1.5), ("A", "max"): (7, "2010-01-01", 7.0, 1.5), ("B", "max"): (1, "2015-01-01", 1.0, 1.0)}
    for period in ("1mo", "5y", "max"):
        assert {(r.ticker, r.period): r["count"] for r in M.price_history(bars, period).collect()} == {k: v[0] for k, v in got.items() if k[1] == period}
    assert M.price_windows(bars.limit(0)).count() == 0 and M.price_history(bars, "1mo", dt.date(2010, 1, 15)).where("date < '2010-01-02'").count() == 1


def test_long_texts_go_to_python_row_by_row():
    from pyspark.util import PythonEvalType

    from ledgerloom.operators import discovery
    from ledgerloom.sources import documents, feeds
    for f in (feeds._decode, feeds._items, documents._html_pages, discovery._page_anchors):
        assert f.evalType == PythonEvalType.SQL_BATCHED_UDF
