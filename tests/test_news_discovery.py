from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import urls as U
from ledgerloom.operators import discovery as D
from ledgerloom.operators import news as N
from ledgerloom.sources import feeds as S


def each(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", column("v").alias("o")).orderBy("i").collect()]


def test_text_rules(spark):
    assert each(spark, S.decode_xml_text, [" <![CDATA[a &amp;amp;lt; b]]> ", "x", None]) == ["a < b", "x", None]
    assert each(spark, S.strip_html, ["&lt;p&gt;Hi <b>you</b>&lt;script&gt;no&lt;/script&gt;&nbsp;x"]) == ["Hi you x"]
    assert each(spark, S.unwrap_bing, ["http://b/?a=1&url=http%3A%2F%2Fx%2Fy%3Fz", "http://b/?curl=1", "http://b/?url="]) == ["http://x/y?z", "http://b/?curl=1", "http://b/?url="]
    got = each(spark, S.source_from_title, ["A fairly long head - part - Reuters", "Short - X", "No dash at all here"])
    assert [tuple(g) for g in got] == [("A fairly long head - part", "Reuters"), ("Short - X", ""), ("No dash at all here", "")]
    assert each(spark, N.normalize_title, ["  Büro: 5%  up! ", None]) == ["b ro 5 up", None]
    assert each(spark, S.origin_host, ["https://www.a.example:80/x", "nothing"]) == ["a.example", ""]


def test_dates(spark):
    got = each(spark, S.parse_news_date, ["Tue, 05 Nov 2024 10:00:00 GMT", "5 Nov 2024 10:00:00 +0530", "2024-11-05T10:00:00Z", "2024-11-05", "soon", "Tue, 05 Nov 2024 10:00:00 PST", ""])
    assert got == [dt.datetime(2024, 11, 5, 10), dt.datetime(2024, 11, 5, 4, 30), dt.datetime(2024, 11, 5, 10), dt.datetime(2024, 11, 5), None, dt.datetime(2024, 11, 5, 18), None]


def test_snippet(spark):
    df = spark.createDataFrame([("<p>The Title and more</p>", "the title"), ("http://x", "t"), ("a href=1", "t"), ("w" * 400, "t"), (None, "t")], "raw string, title string")
    got = [r.s for r in df.select(S.clean_snippet("raw", "title").alias("s")).collect()]
    assert got[:3] == ["", "", ""] and len(got[3]) == 280


def test_rss(spark):
    xml = ('<rss xmlns:dc="urn:x"><channel><item><title><![CDATA[Big news about things - Wire]]></title><guid>http://g/1</guid><link>http://l/1</link>'
           "<pubDate>Tue, 05 Nov 2024 10:00:00 GMT</pubDate><description>&lt;b&gt;Body&lt;/b&gt;</description></item><item><title> </title></item>"
           "<item><title>Second</title><link>http://b/?url=http%3A%2F%2Fz</link><dc:creator>Ann</dc:creator></item></channel></rss>")
    df = spark.createDataFrame([("f", xml), ("g", xml[:-6])], "feed string, xml string")
    got = S.rss_items(df, ["feed"]).orderBy("pos").collect()
    assert [(r.title, r.link, r.source, r.snippet) for r in got] == [("Big news about things", "http://g/1", "Wire", "Body"), ("Second", "http://z", "Ann", "")]
    news = S.to_news(S.rss_items(df, ["feed"]).withColumns({"origin": F.lit("bing"), "market": F.lit("US")})).orderBy("pos").collect()
    assert news[1].id.startswith("bing-") and len(news[1].id) == 15


ITEM = "ticker string, name string, title string, snippet string, origin string, market string, published_at timestamp, pos int"


def test_company_news(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("INFY.NS", "Infosys Limited", f"Infosys item {i}", "", "bing", "IN", day + dt.timedelta(i), i) for i in range(4)]
    rows += [("INFY.NS", "Infosys Limited", "Other topic", "", "google-news", "IN", None, 9), ("INFY.NS", "Infosys Limited", "INFOSYS item 1!", "", "google-news", "IN", day, 8),
             ("INFY.NS", "Infosys Limited", "unrelated", "", "yahoo", "IN", day, 1), ("X", "", "only one", "", "bing", "US", day, 1)]
    got = {}
    for r in N.collect_company_news(spark.createDataFrame(rows, ITEM)).orderBy("rank").collect():
        got.setdefault(r.ticker, []).append((r.title, r.origin))
    assert got == {"INFY.NS": [("Infosys item 3", "bing"), ("Infosys item 2", "bing"), ("INFOSYS item 1!", "google-news"), ("Infosys item 0", "bing")], "X": [("only one", "bing")]}


def test_merge_keeps_all_without_a_limit(spark):
    rows = [("A", "", f"title {i}", "", "bing", "US", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i) for i in range(100)]
    items = spark.createDataFrame(rows, ITEM)
    for limit, last in ((None, -1), (40, 59)):
        got = N.merge_news(items, ["ticker"], limit=limit).orderBy("rank").collect()
        assert [r.pos for r in got] == list(range(99, last, -1))


def test_urls(spark):
    assert each(spark, U.canonicalize_url, ["HTTPS://A.Example/P/?b=2&utm_source=x&a=1&b=3&c=#f", "http://x/", "http://x/a//", "http://x", "/rel/?ref=1", "http://x/p;v=1?q=a%20b"]) == [
        "https://a.example/P?a=1&b=2", "http://x/", "http://x/a", "http://x", "/rel", "http://x/p?q=a b"]
    assert each(spark, U.registrable_domain, ["https://www.a.co.in/x", "http://b.c.example.com:80", "co.uk", "localhost", "http://U@shop.example.org./",
                                             "https://ir.acme.com.co/a", "x.firm.in", "www.b.co.ke", "com.example.de"]) == [
        "a.co.in", "example.com", "co.uk", "localhost.", "example.org", "acme.com.co", "x.firm.in", "b.co.ke", "example.de"]
    assert each(spark, D.unwrap_search_url, ["//d/l/?uddg=https%3A%2F%2Fx&target=y", "http://p/?target=z", "http://p"]) == ["https://x", "z", "http://p"]


def test_anchors_and_blocks(spark):
    html = "<a href='/a'> One <b> two </b></a><a name=x>no</a><a href=\"b.pdf\">B<a href='//c.example/c'></a>" + " " * 500
    df = spark.createDataFrame([("p", "http://x.example/dir/page", html), ("q", "http://x", None), ("r", "http://x", "Just a moment" + "x" * 600)], "id string, url string, html string")
    got = [(r.text, r.href, r.absolute_url) for r in D.extract_anchors(df.where("id = 'p'"), ["id"]).orderBy("pos").collect()]
    assert got == [("Onetwo", "/a", "http://x.example/a"), ("B", "b.pdf", "http://x.example/dir/b.pdf"), ("", "//c.example/c", "http://c.example/c")]
    assert {r.id: r.b for r in df.select("id", D.looks_blocked("html").alias("b")).collect()} == {"p": False, "q": True, "r": True}


@pytest.mark.parametrize("text, expected", [
    ("Annual Report FY 2023-24", ("FY2024", None, 2023)), ("Q3 FY24 results", ("FY2024", "Q3", 2023)), ("FY1999", ("FY1999", None, 1998)), ("fy98", ("FY1998", None, 1997)),
    ("Report 2019–20 H1", ("FY2020", "H1", 2019)), ("in 2022", (None, None, 2022)), ("in 2017", (None, None, None)), ("9M update", (None, "9M", None))])
def test_periods(spark, text, expected):
    assert tuple(each(spark, D.extract_period, [text])[0]) == expected


def test_scoring(spark):
    df = spark.createDataFrame([("http://x/Investor-Relations", "Investors", "Annual report, dividend, board of directors, share price, stock information", "navigation"),
                                ("http://x/a", None, None, "search_index")], "url string, text string, content string, method string")
    got = [r.s for r in df.select(D.score_ir_candidate().alias("s")).collect()]
    assert (got[0].score, got[1].score) == (40 + 25 + 10 + 3 + 5, 3)
    assert len(got[0].evidence) == 7 and got[1].evidence == ["+3 found via search index"]


def test_discovery(spark):
    pages = spark.createDataFrame([
        ("http://s.example/ir", "<a href='/r/annual-report-2022.pdf'>Annual report</a><a href='/r/annual-report-2022.pdf?utm_source=z'>again</a><a href='/results'>Quarterly results</a><a href='/policies'>Policies</a>"),
        ("http://s.example/results", "<a href='q1.pdf'>Quarterly report Q1 2023</a><a href='photo.pdf'>Photo</a>"), ("http://s.example/policies", "<a href='/r/x.pdf'>Annual return 2024</a>")], "url string, html string")
    anchors = D.extract_anchors(pages, []).withColumn("page", U.canonicalize_url("page_url"))
    ir = spark.createDataFrame([("http://s.example", "http://s.example/ir")], "site string, url string")
    got = [(r.url, r.doc_type, r.year) for r in D.discover_documents(ir, anchors).orderBy("rank").collect()]
    assert got == [("http://s.example/r/x.pdf", "annual_report", 2024), ("http://s.example/r/annual-report-2022.pdf", "annual_report", 2022), ("http://s.example/q1.pdf", "quarterly_result", 2023)]
    visits = [(r.url, r.visit) for r in D.subpages(anchors.join(ir.withColumnRenamed("url", "page"), "page")).orderBy("visit").collect()]
    # A PDF link with a query is not known to be one by its end.
    assert visits == [("http://s.example/r/annual-report-2022.pdf", 1), ("http://s.example/results", 2), ("http://s.example/policies", 3)]
