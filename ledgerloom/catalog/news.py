"""Queries over news.

A source of the documents is a company; the first line of a document is a headline, the other lines are
the text below it, and its id decides origin, date and link.  Feeds and search answers are written by Spark from
at most fifty documents each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query
from ledgerloom.operators import news as N
from ledgerloom.sources import feeds as S
from ledgerloom.tables import table

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"
# Tickers and names of the companies, by number of the source.
NAMES = (("THE.NS", "Thing Company"), ("DER", "Deutsche Group"), ("que.BO", ""), ("ZXQW", "Limited the Corp"), ("X", "Ention Eleven Inc"))
TICKER = "element_at(array(" + ", ".join(f"'{t}'" for t, _ in NAMES) + "), cast(pmod(hash_no, 5) + 1 as int))"
NAME = "element_at(array(" + ", ".join(f"'{n}'" for _, n in NAMES) + "), cast(pmod(hash_no, 5) + 1 as int))"


# The text below the first line.
REST = "coalesce(substring(text, length(element_at(split(text, '\\n'), 1)) + 2), '')"
REST_SQL = "coalesce(substr(text, length(string_split(text, chr(10))[1]) + 2), '')"


def items(spark, folder):
    d = table(spark, folder, "documents").selectExpr("*", "cast(substring(source, 4) as int) AS hash_no", "element_at(split(text, '\\n'), 1) AS line").withColumn("rest", F.expr(REST))
    return d.selectExpr(
        "doc_id AS pos", "source AS company_id", f"{TICKER} AS ticker", f"{NAME} AS name", "line AS title", "concat(if(doc_id % 4 = 0, concat('Report on ', lang, ' Deutsche '), ''), rest) AS snippet",
        "case doc_id % 3 when 0 then 'google-news' when 1 then 'bing' else 'yahoo' end AS origin", "if(doc_id % 2 = 0, 'US', 'IN') AS market",
        "if(doc_id % 10 = 0, null, timestamp_seconds(1700000000 + (doc_id * 7919) % 500000)) AS published_at", "concat('https://news.example.com/', doc_id) AS link", "lang")


ITEM_SQL = f"""it AS (SELECT doc_id AS pos, source AS company_id, [{', '.join(f"'{t}'" for t, _ in NAMES)}][CAST(substr(source, 4) AS INTEGER) % 5 + 1] AS ticker,
 [{', '.join(f"'{n}'" for _, n in NAMES)}][CAST(substr(source, 4) AS INTEGER) % 5 + 1] AS name, string_split(text, chr(10))[1] AS title,
 CASE WHEN doc_id % 4 = 0 THEN 'Report on ' || lang || ' Deutsche ' ELSE '' END || {REST_SQL} AS snippet, CASE doc_id % 3 WHEN 0 THEN 'google-news' WHEN 1 THEN 'bing' ELSE 'yahoo' END AS origin,
 doc_id % 3 + 1 AS grp, CASE WHEN doc_id % 2 = 0 THEN 'US' ELSE 'IN' END AS market, CASE WHEN doc_id % 10 <> 0 THEN make_timestamp((1700000000 + (doc_id * 7919) % 500000) * 1000000) END AS published_at FROM documents)"""


def title_sql(e):
    return f"trim(regexp_replace(regexp_replace(lower({e}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def relevant_sql(t="ticker", n="name"):
    hay = "lower(title || ' ' || snippet)"
    sym = f"lower(regexp_replace({t}, '(?i)\\.(NS|BO)$', ''))"
    words = (f"list_filter(string_split(lower({n}), ' '), lambda w: length(w) > 4 AND w NOT IN ('class', 'group', 'inc', 'corp', 'ltd', 'limited', 'the', 'and', 'company'))")
    return (f"((length({sym}) >= 2 AND contains({hay}, {sym})) OR ({n} <> '' AND (contains({hay}, lower({n})) "
            f"OR len(list_filter({words}, lambda w: contains({hay}, w))) > 0)))")


def merge_sql(source, key, out):
    return f"""{out}_u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}, {title_sql('title')} ORDER BY grp, pos) AS dup FROM {source} WHERE {title_sql('title')} <> '') WHERE dup = 1),
{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY published_at DESC NULLS LAST, grp, pos) AS rank FROM {out}_u))"""


@query("normalize_title", f"WITH {ITEM_SQL} SELECT pos, {title_sql('title')} AS title_key FROM it")
def normalize_title(spark, folder):
    return items(spark, folder).select("pos", N.normalize_title("title").alias("title_key"))


@query("merge_news", f"WITH {ITEM_SQL}, {merge_sql('it', 'company_id', 'm')} SELECT company_id, CAST(rank AS INTEGER) AS rank, pos FROM m")
def merge_news(spark, folder):
    return N.merge_news(items(spark, folder), ["company_id"]).select("company_id", "rank", "pos")


@query("is_relevant", f"WITH {ITEM_SQL} SELECT pos, {relevant_sql()} AS relevant FROM it")
def is_relevant(spark, folder):
    return items(spark, folder).select("pos", N.is_relevant().alias("relevant"))


COLLECT_SQL = f"""{ITEM_SQL}, wanted AS (SELECT * FROM it WHERE origin <> 'yahoo' OR {relevant_sql()}), {merge_sql('wanted', 'company_id', 'm')},
f AS (SELECT *, count(*) FILTER ({relevant_sql()}) OVER (PARTITION BY company_id) AS n, {relevant_sql()} AS rel FROM m),
cn AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY company_id ORDER BY rank) AS INTEGER) AS rank) FROM f WHERE n < 4 OR rel)"""


@query("collect_company_news", f"WITH {COLLECT_SQL} SELECT company_id, rank, pos FROM cn")
def collect_company_news(spark, folder):
    return N.collect_company_news(items(spark, folder), ["company_id", "ticker", "name"]).select("company_id", "rank", "pos")


@query("news_sources", f"WITH {COLLECT_SQL}, a AS (SELECT company_id, origin, min(rank) AS r FROM cn GROUP BY ALL) SELECT company_id, string_agg(origin, ',' ORDER BY r) AS sources FROM a GROUP BY 1")
def news_sources(spark, folder):
    return N.news_sources(N.collect_company_news(items(spark, folder), ["company_id", "ticker", "name"]), ["company_id"])


@query("collect_market_news", f"WITH {ITEM_SQL}, w AS (SELECT * FROM it WHERE origin <> 'yahoo' OR market = 'US'), {merge_sql('w', 'market', 'm')} SELECT market, CAST(rank AS INTEGER) AS rank, pos FROM m")
def collect_market_news(spark, folder):
    return N.collect_market_news(items(spark, folder)).select("market", "rank", "pos")


@query("company_query", """SELECT s_suppkey, '"' || CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 4 = 1 THEN 'Infosys' ELSE 'S' || s_suppkey END || '" OR ' || CASE WHEN s_suppkey % 4 = 1 THEN 'INFY' ELSE 'S' || s_suppkey END
 || ' (stock OR shares OR earnings)' AS query, CASE WHEN s_suppkey % 4 = 1 OR s_suppkey % 4 = 2 THEN 'IN' ELSE 'US' END AS market FROM supplier""")
def company_query(spark, folder):
    c = table(spark, folder, "supplier").selectExpr(
        "s_suppkey", "case s_suppkey % 4 when 1 then 'INFY.NS' when 2 then concat('S', s_suppkey, '.BO') else concat('S', s_suppkey) end AS ticker", "if(s_suppkey % 3 = 0, s_name, null) AS name")
    return N.company_query(c).select("s_suppkey", "query", "market")


# --- text rules ---------------------------------------------------------------------

def unescape_sql(e):
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        e = f"replace({e}, '{a}', '{b}')"
    return f"regexp_replace({e}, '&amp;?', '&', 'g')"


@query("decode_xml_text", f"SELECT page_id, length(t) AS size, md5(t) AS digest FROM (SELECT page_id, trim({unescape_sql('html')}, {WS}) AS t FROM pages)")
def decode_xml_text(spark, folder):
    t = table(spark, folder, "pages").select("page_id", S.decode_xml_text(F.concat(F.lit("<![CDATA["), "html", F.lit("]]> "))).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("size"), F.md5("t").alias("digest"))


STRIP_SQL = f"""trim(regexp_replace(regexp_replace(regexp_replace({unescape_sql('html')}, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"""


@query("strip_html", f"SELECT page_id, length(t) AS size, md5(t) AS digest FROM (SELECT page_id, {STRIP_SQL} AS t FROM pages)")
def strip_html(spark, folder):
    t = table(spark, folder, "pages").select("page_id", S.strip_html("html").alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("size"), F.md5("t").alias("digest"))


@query("clean_snippet", f"""WITH s AS (SELECT page_id, {STRIP_SQL} AS t FROM pages)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 4 = 1 THEN '' ELSE left(t, 280) END AS snippet FROM s""")
def clean_snippet(spark, folder):
    p = table(spark, folder, "pages").withColumn("title", F.expr("if(page_id % 4 = 0, upper(left(regexp_extract(html, '<title>([^<&]*)', 1), 40)), 'x')"))
    raw = F.when(F.col("page_id") % 4 == 1, F.concat(F.lit("http "), "html")).when(
        F.col("page_id") % 4 == 0, F.concat(F.lit("<b>"), F.lower("title"), F.lit("</b>"), "html")).otherwise(F.col("html"))
    return p.select("page_id", S.clean_snippet(raw, F.col("title")).alias("snippet"))


@query("unwrap_bing", "SELECT page_id, CASE page_id % 3 WHEN 2 THEN url ELSE 'https://o.example.com/p%20q?a=b' || page_id END AS link FROM pages")
def unwrap_bing(spark, folder):
    p = table(spark, folder, "pages").selectExpr("page_id", """case page_id % 3 when 2 then url when 1 then concat('http://www.bing.com/news/apiclick.aspx?ref=x&aid=&url=', url_encode(concat('https://o.example.com/p%20q?a=b', page_id)), '&c=1#f')
      else concat('//bing.com/a?url=', url_encode(concat('https://o.example.com/p%20q?a=b', page_id)), '&url=second') end AS link""")
    return p.select("page_id", S.unwrap_bing("link").alias("link"))


@query("source_from_title", """SELECT doc_id, CASE WHEN doc_id % 4 <> 2 THEN trim(t) ELSE raw END AS title, CASE WHEN doc_id % 4 IN (0, 1) THEN 'Daily ' || source ELSE '' END AS source FROM (
 SELECT *, CASE doc_id % 4 WHEN 0 THEN t || ' - Daily ' || source WHEN 1 THEN t || ' - Daily ' || source WHEN 2 THEN 'short - ' || source ELSE t || ' - ' END AS raw
 FROM (SELECT doc_id, source, CASE doc_id % 4 WHEN 1 THEN 'A long head - ' || lang || text ELSE 'Headline about ' || lang || text END AS t FROM documents))""")
def source_from_title(spark, folder):
    d = table(spark, folder, "documents").selectExpr("doc_id", "source", "if(doc_id % 4 = 1, concat('A long head - ', lang, text), concat('Headline about ', lang, text)) AS t").selectExpr(
        "doc_id", "case doc_id % 4 when 2 then concat('short - ', source) when 3 then concat(t, ' - ') else concat(t, ' - Daily ', source) end AS raw")
    return d.select("doc_id", S.source_from_title("raw").alias("s")).select("doc_id", "s.title", "s.source")


@query("parse_news_date", """SELECT event_id, CASE WHEN event_id % 7 IN (5, 6) THEN NULL WHEN event_id % 7 = 1 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE WHEN event_id % 7 = 3 THEN date_trunc('second', ts) + INTERVAL 5 HOUR
 WHEN event_id % 7 = 4 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) END AS published FROM events""")
def parse_news_date(spark, folder):
    e = table(spark, folder, "events").selectExpr("event_id", """case event_id % 7 when 0 then concat('Tue, ', date_format(ts, 'dd MMM yyyy HH:mm:ss'), ' GMT') when 1 then concat('Wed, ', date_format(ts, 'd MMM yyyy HH:mm:ss'), ' +0530')
      when 2 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") when 3 then concat(date_format(ts, 'dd MMM yyyy HH:mm:ss'), ' EST') when 4 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') when 5 then 'yesterday' else '' end AS d""")
    return e.select("event_id", S.parse_news_date("d").alias("published"))


@query("origin_host", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)), '^www\\.', '') AS origin FROM pages")
def origin_host(spark, folder):
    return table(spark, folder, "pages").select("page_id", S.origin_host("url").alias("origin"))


# --- feeds --------------------------------------------------------------------------

def feeds(spark, folder):
    """RSS documents of a source, fifty ids each; every seventh feed breaks off."""
    d = table(spark, folder, "documents").selectExpr("doc_id", "source", "doc_id div 50 AS feed_no", "regexp_replace(element_at(split(text, '\\n'), 1), '[\\\\p{Cc}<]', ' ') AS line",
                                                       f"regexp_replace({REST}, '[\\\\p{{Cc}}<>&]', ' ') AS rest")
    item = d.selectExpr("source", "feed_no", "doc_id", """concat('<item><title><![CDATA[', line, ' &amp;amp; Co - Reuters ', doc_id, ']]></title>',
      if(doc_id % 3 = 0, '<guid>', '<link>'), if(doc_id % 2 = 0, concat('https://www.bing.com/n?url=https%3A%2F%2Fa.example%2F', doc_id, '&amp;x=1'), concat('https://b.example/', doc_id)), if(doc_id % 3 = 0, '</guid>', '</link>'),
      '<pubDate>', date_format(timestamp_seconds(1700000000 + doc_id * 60), 'dd MMM yyyy HH:mm:ss'), ' GMT</pubDate>',
      if(doc_id % 5 = 0, concat('<dc:creator>Writer ', doc_id, '</dc:creator>'), ''), '<description>&lt;p&gt;Some &lt;b&gt;news&lt;/b&gt; ', doc_id, ' ', rest, '&lt;/p&gt;</description></item>') AS x""")
    g = item.groupBy("source", "feed_no").agg(F.array_sort(F.collect_list(F.struct("doc_id", "x"))).alias("l"))
    return g.select("source", "feed_no", F.concat(F.lit('<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Feed</title>'), F.array_join("l.x", ""),
                                                  F.when(F.col("feed_no") % 7 == 3, "</channel>").otherwise("</channel></rss>")).alias("xml"))


FEED_SQL = f"""fd0 AS (SELECT doc_id, source AS company_id, doc_id // 50 AS feed_no, trim(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '[\\x00-\\x1f\\x7f-\\x9f<]', ' ', 'g') || ' & Co', '\\s+', ' ', 'g')) AS head,
 CASE WHEN doc_id % 2 = 0 THEN 'https://a.example/' || doc_id ELSE 'https://b.example/' || doc_id END AS link, make_timestamp((1700000000 + doc_id * 60) * 1000000) AS published_at,
 left(trim(regexp_replace('Some news ' || doc_id || ' ' || regexp_replace({REST_SQL}, '[\\x00-\\x1f\\x7f-\\x9f<>&]', ' ', 'g'), '\\s+', ' ', 'g')), 280) AS snippet FROM documents WHERE (doc_id // 50) % 7 <> 3),
fd AS (SELECT *, CASE WHEN length(head) > 12 THEN head ELSE head || ' - Reuters ' || doc_id END AS title,
 CASE WHEN doc_id % 5 = 0 THEN 'Writer ' || doc_id WHEN length(head) > 12 THEN 'Reuters ' || doc_id ELSE 'News' END AS source FROM fd0)"""


@query("rss_items", f"WITH {FEED_SQL} SELECT company_id, md5(title) AS title, link, published_at, source, snippet FROM fd")
def rss_items(spark, folder):
    return _rss(spark, folder).select("company_id", F.md5("title").alias("title"), "link", "published_at", "source", "snippet")


def _rss(spark, folder):
    return S.rss_items(feeds(spark, folder).withColumnRenamed("source", "company_id"), ["company_id", "feed_no"])


@query("to_news", f"""WITH {FEED_SQL} SELECT company_id, 'bing-' || left(md5(link), 10) AS id, md5(title) AS title, source, link AS url, origin, 'US' AS market FROM (SELECT *, 'bing' AS origin FROM fd)""")
def to_news(spark, folder):
    n = S.to_news(_rss(spark, folder).withColumns({"origin": F.lit("bing"), "market": F.lit("US")}))
    return n.select("company_id", "id", F.md5("title").alias("title"), "source", "url", "origin", "market")


@query("search_news_json", """SELECT source AS company_id, 'yahoo-' || CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id ELSE left(md5('https://y.example/' || doc_id), 10) END AS id, md5(text) AS title,
 CASE WHEN doc_id % 4 = 0 THEN 'Yahoo Finance' ELSE 'Pub ' || lang END AS publisher, CASE WHEN doc_id % 5 <> 0 THEN make_timestamp((1700000000 + doc_id) * 1000000) END AS published_at,
 CASE WHEN doc_id % 2 = 0 THEN 'https://i.example/' || doc_id END AS thumbnail FROM documents WHERE doc_id % 6 <> 5 AND text <> ''""")
def search_news_json(spark, folder):
    d = table(spark, folder, "documents").selectExpr("source AS company_id", "doc_id div 50 AS part", """named_struct('uuid', if(doc_id % 3 = 0, concat('u', doc_id), null), 'title', text, 'link', if(doc_id % 6 = 5, '', concat('https://y.example/', doc_id)),
      'publisher', if(doc_id % 4 = 0, '', concat('Pub ', lang)), 'providerPublishTime', if(doc_id % 5 = 0, null, 1700000000 + doc_id),
      'thumbnail', if(doc_id % 2 = 0, named_struct('resolutions', array(named_struct('url', concat('https://i.example/', doc_id)), named_struct('url', 'second'))), null)) AS n""")
    docs = d.groupBy("company_id", "part").agg(F.to_json(F.struct(F.collect_list("n").alias("news"))).alias("search_json"))
    n = S.search_news_json(docs, ["company_id"])
    return n.select("company_id", "id", F.md5("title").alias("title"), F.col("source").alias("publisher"), "published_at", "thumbnail")
