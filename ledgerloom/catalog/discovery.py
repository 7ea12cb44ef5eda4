"""Queries over crawled pages.

The given pages have no investor links, so links are added to their navigation by rule
and every site gets crawled investor pages made from its own text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query
from ledgerloom.functions import urls as U
from ledgerloom.operators import discovery as D
from ledgerloom.operators.domains import registrable_domains
from ledgerloom.session import materialize
from ledgerloom.tables import table

LINKS = (
    (3, 0, '<a href="/investor-relations/?utm_source=nav">Investor Relations</a>'), (4, 1, '<a href="/about/investors#x">For <b>Investors</b></a>'),
    (5, 2, '<a href="files/annual_report_FY2023-24.pdf">Annual Report 2023-24</a>'), (7, 3, '<a href="/q/Q2-fy24-quarterly-results.PDF"></a>'),
    (6, 4, '<a href="/governance/annual-reports">Annual reports &amp; governance</a>'), (8, 5, '<a href="https://cdn.other.org/investor-presentation-2021.pdf">Deck</a>'),
    (9, 6, '<a href="/transcript.pdf?id=5">Earnings call transcript H1 2020</a>'), (10, 7, '<a href="/policies">Policies</a>'),
)
ADDED = "concat(" + ", ".join(f"if(page_id % {m} = {r}, '{h}', '')" for m, r, h in LINKS) + ")"
ADDED_SQL = " || ".join(f"CASE WHEN page_id % {m} = {r} THEN '{h}' ELSE '' END" for m, r, h in LINKS)


def ir_pages(spark, folder):
    return table(spark, folder, "pages").selectExpr("page_id", "url", f"replace(html, '<nav><ul>', concat('<nav><ul>', {ADDED})) AS html",
                                                    "lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS site")


PAGE_SQL = f"""ip AS (SELECT page_id, url, replace(html, '<nav><ul>', '<nav><ul>' || {ADDED_SQL}) AS html, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS site FROM pages)"""
ANCHOR_SQL = PAGE_SQL + r""", am AS (SELECT page_id, url, site, length(html) < 500 AS blocked, regexp_extract_all(html, '<a href="[^"]*">.*?</a>') AS al FROM ip),
an0 AS (SELECT page_id, url, site, blocked, unnest(al) AS a, generate_subscripts(al, 1) - 1 AS pos FROM am),
an AS (SELECT page_id, url, site, blocked, CAST(pos AS INTEGER) AS pos, regexp_extract(a, '<a href="([^"]*)">', 1) AS href,
 replace(regexp_replace(regexp_extract(a, '<a href="[^"]*">(.*?)</a>', 1), '\s*<[^>]*>\s*', '', 'g'), '&amp;', '&') AS text FROM an0),
ab AS (SELECT *, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href
 ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[?#].*$', ''), '[^/]*$', '') || href END AS absolute_url FROM an)"""


def anchors(spark, folder):
    return D.extract_anchors(ir_pages(spark, folder), ["page_id", "site"])


@query("extract_anchors", f"WITH {ANCHOR_SQL} SELECT page_id, pos, href, text, absolute_url FROM ab")
def extract_anchors(spark, folder):
    return anchors(spark, folder).select("page_id", "pos", "href", "text", "absolute_url")


@query("looks_blocked", "SELECT page_id, page_id % 9 = 0 OR length(html) < 500 AS blocked FROM pages")
def looks_blocked(spark, folder):
    p = table(spark, folder, "pages").selectExpr("page_id", "if(page_id % 9 = 0, if(page_id % 2 = 0, concat('Just a MOMENT', html), null), html) AS html")
    return p.select("page_id", D.looks_blocked("html").alias("blocked"))


STATUS = "CASE p_size % 8 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 503 WHEN 5 THEN NULL WHEN 6 THEN 302 ELSE 418 END"


@query("page_status", f"""SELECT p_partkey, CASE s WHEN 200 THEN 'accessible' WHEN 301 THEN 'redirected' WHEN 302 THEN 'redirected' WHEN 403 THEN 'blocked_403' WHEN 404 THEN 'not_found_404'
 WHEN 503 THEN 'server_error' WHEN 418 THEN 'unknown' ELSE 'connection_error' END AS status FROM (SELECT p_partkey, {STATUS} AS s FROM part)""")
def page_status(spark, folder):
    return table(spark, folder, "part").selectExpr("p_partkey", f"cast({STATUS} as int) AS s").select("p_partkey", D.page_status("s").alias("status"))


@query("unwrap_search_url", "SELECT page_id, CASE page_id % 4 WHEN 3 THEN url ELSE 'https://x.example/a b?c=' || page_id END AS target FROM pages")
def unwrap_search_url(spark, folder):
    p = table(spark, folder, "pages").selectExpr("page_id", """case page_id % 4 when 3 then url else concat('//duck.example/l/?kh=1&', element_at(array('uddg', 'url', 'target'), cast(page_id % 4 + 1 as int)), '=',
      url_encode(concat('https://x.example/a b?c=', page_id)), '&rut=1') end AS href""")
    return p.select("page_id", D.unwrap_search_url("href").alias("target"))


# The links of the pages in canonical form; the only parameters are known ones.
CANON_SQL = r"""regexp_replace(lower(regexp_extract({u}, '^(https?://[^/?#]*)', 1)) || regexp_replace(regexp_replace(regexp_replace({u}, '^https?://[^/?#]*', ''), '[?#].*$', ''), '(.)/+$', '\1')
 || CASE WHEN regexp_matches({u}, '[?&]page=2') THEN '?page=2' WHEN regexp_matches({u}, '[?&]id=5') THEN '?id=5' ELSE '' END, '^(https?://[^/]*)/$', '\1/')"""


def canon(u):
    return CANON_SQL.format(u=u)


@query("canonicalize_url", f"SELECT page_id, {canon('url')} AS canonical FROM pages")
def canonicalize_url(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.canonicalize_url("url").alias("canonical"))


@query("canonicalize_link", f"WITH {ANCHOR_SQL} SELECT page_id, pos, {canon('absolute_url')} AS canonical FROM ab")
def canonicalize_link(spark, folder):
    return anchors(spark, folder).select("page_id", "pos", U.canonicalize_url("absolute_url").alias("canonical"))


@query("registrable_domain", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(h, '([^.]+\\.[^.]+)$', 1) WHEN 1 THEN regexp_extract(h, '([^.]+)\\.[^.]+$', 1) || '.co.in' ELSE h1 || '.' END AS domain
FROM (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)) AS h, lower(regexp_extract(url, '^https?://([^./:?#]*)', 1)) AS h1 FROM pages)""")
def registrable_domain(spark, folder):
    p = table(spark, folder, "pages").selectExpr("page_id", r"""case page_id % 3 when 0 then regexp_replace(url, '^(https?://)([^/]*)', '$1user@$2:8080') when 1 then regexp_replace(url, '^(https?://[^/]*)\\.[^./]+(/|$)', '$1.CO.in$2')
      else concat('http://', regexp_extract(url, '^https?://([^./:?#]*)', 1), '/x.y') end AS url""")
    return p.select("page_id", U.registrable_domain("url").alias("domain"))


# Rules of each kind.
SUFFIX_RULES = ("com", "uk", "co.uk", "jp", "kyoto.jp", "ide.kyoto.jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck")
_TAILS = ("com", "co.uk", "ide.kyoto.jp", "c.kobe.jp", "city.kobe.jp", "www.ck", "x.ck", "other.test")


@query("registrable_domain_rules", """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^./:?#]*)', 1)) AS a,
 ['com', 'co.uk', 'ide.kyoto.jp', 'c.kobe.jp', 'city.kobe.jp', 'www.ck', 'x.ck', 'other.test'][page_id % 8 + 1] AS t, page_id % 8 AS k, (page_id // 8) % 3 AS n FROM pages)
SELECT page_id, CASE WHEN k IN (4, 5) THEN t WHEN k = 7 THEN 'other.test' WHEN n = 0 THEN NULL ELSE a || '.' || t END AS domain FROM p""")
def registrable_domain_rules(spark, folder):
    """Hosts made of a page's first label, none to two times, and a suffix of each kind."""
    tails = ", ".join(f"'{t}'" for t in _TAILS)
    urls = table(spark, folder, "pages").selectExpr("page_id", f"""concat('https://', repeat(concat(regexp_extract(url, '^https?://([^./:?#]*)', 1), '.'), cast((page_id div 8) % 3 as int)),
      element_at(array({tails}), cast(page_id % 8 + 1 as int)), '/a') AS url""")
    rules = spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")
    return registrable_domains(urls, "url", rules).select("page_id", "domain")


@query("same_domain", f"WITH {ANCHOR_SQL} SELECT page_id, pos, href NOT LIKE 'https://cdn.other.org%' AS same FROM ab")
def same_domain(spark, folder):
    return anchors(spark, folder).select("page_id", "pos", U.same_domain("page_url", "absolute_url").alias("same"))


def norm(e):
    return f"trim(regexp_replace(regexp_replace(lower({e}), '[-_+]', ' ', 'g'), '\\s+', ' ', 'g'))"


def has_any(hay, words):
    return "(" + " OR ".join(f"contains({hay}, '{w}')" for w in words) + ")"


HAY = norm("text || ' ' || href")


@query("normalize_for_matching", f"WITH {ANCHOR_SQL} SELECT page_id, pos, {HAY} AS hay FROM ab")
def normalize_for_matching(spark, folder):
    return anchors(spark, folder).select("page_id", "pos", D.normalize_for_matching(F.concat_ws(" ", "text", "href")).alias("hay"))


@query("is_ir_link", f"WITH {ANCHOR_SQL} SELECT page_id, pos, {has_any(HAY, D.IR_KEYWORDS)} AS ir FROM ab")
def is_ir_link(spark, folder):
    return anchors(spark, folder).select("page_id", "pos", D.is_ir_link().alias("ir"))


NAV_SQL = f"{ANCHOR_SQL}, nav AS (SELECT site, {canon('absolute_url')} AS url, text, page_id * 1000 + pos AS pos FROM ab WHERE {has_any(HAY, D.IR_KEYWORDS)})"


def nav(spark, folder):
    """All pages of a site count as its start pages here, in order of their ids."""
    a = anchors(spark, folder).withColumn("pos", F.col("page_id") * 1000 + F.col("pos"))
    return D.nav_candidates(a)


@query("nav_candidates", f"WITH {NAV_SQL} SELECT site, url, text, pos FROM nav")
def nav_candidates(spark, folder):
    return nav(spark, folder).select("site", "url", "text", "pos")


def sites(spark, folder):
    return ir_pages(spark, folder).select("site").distinct()


def search_results(spark, folder):
    """Search results of a site: two links on its domain, one elsewhere, one PDF, per page."""
    return ir_pages(spark, folder).selectExpr("site", "page_id", "inline(array(" + ", ".join(
        f"named_struct('pos', page_id * 10 + {i}, 'href', {h}, 'text', '{t}')" for i, (h, t) in enumerate((
            ("concat('//duck.example/l/?uddg=', url_encode(concat(site, '/shareholders/')))", "Shareholder services"), ("'https://elsewhere.invalid/investors'", "Investors"),
            ("concat(site, '/docs/annual-report-', 2015 + page_id % 10, '.pdf?utm_medium=s')", "")))) + "))").drop("page_id")


SEARCH_SQL = f"""{NAV_SQL}, sr AS (SELECT site, site || '/shareholders' AS url, 'Shareholder services' AS text, page_id * 10 AS pos FROM ip
 UNION ALL SELECT site, site || '/docs/annual-report-' || (2015 + page_id % 10) || '.pdf', '', page_id * 10 + 2 FROM ip)"""


@query("search_candidates", f"WITH {SEARCH_SQL} SELECT site, url, text, pos FROM sr")
def search_candidates(spark, folder):
    return D.search_candidates(sites(spark, folder), search_results(spark, folder)).select("site", "url", "text", "pos")


def fetched(spark, folder):
    """Landed fetches: the pages themselves and three investor paths of every site."""
    p = ir_pages(spark, folder)
    own = p.selectExpr("url", "200 AS status", "html")
    made = p.groupBy("site").agg(F.min_by(F.struct("page_id", "html"), "page_id").alias("h")).selectExpr("site", "h.page_id AS page_id", "inline(array(" + ", ".join(
        f"named_struct('path', '{path}', 'status', {s}, 'words', '{w}')" for path, s, w in IR_FETCHES) + "))", "h.html AS html")
    return own.unionByName(made.selectExpr("concat(site, path) AS url", "status", "concat(words, html) AS html"))


IR_FETCHES = (("/investor-relations", 200, "Investor Relations. Annual Report, Dividend, Share Price, Stock Information, board of directors, analyst day"),
              ("/investors", 404, "none"), ("/shareholder", 403, "Financial Results and dividend"))


@query("pattern_candidates", f"""WITH {PAGE_SQL} SELECT DISTINCT site, site || p AS url, m AS text FROM ip, (VALUES ('/investor-relations', '/investor-relations'), ('/investor-relations', '/investor-relations/'), ('/shareholder', '/shareholder')) v(p, m)""")
def pattern_candidates(spark, folder):
    return D.pattern_candidates(sites(spark, folder), fetched(spark, folder)).select("site", "url", "text")


def _ranked(spark, folder):
    s, f = sites(spark, folder), fetched(spark, folder)
    return [nav(spark, folder), D.search_candidates(s, search_results(spark, folder)), D.pattern_candidates(s, f)], f


def _signals_sql(c):
    both = D.STRONG_SIGNALS + D.MEDIUM_SIGNALS
    strong = " + ".join(f"CASE WHEN contains({c}, '{s}') THEN {w} ELSE 0 END" for s, w in both)
    weak = " + ".join(f"CASE WHEN contains({c}, '{s}') THEN 1 ELSE 0 END" for s in D.WEAK_SIGNALS)
    return f"({strong} + least(3, {weak}))"


def _first_sql(c, weights):
    return "CASE " + " ".join(f"WHEN contains({c}, '{w}') THEN {n}" for w, n in weights) + " ELSE 0 END"


SCORE_SQL = f"""{SEARCH_SQL}, fe AS (SELECT {canon('url')} AS url, html FROM ip UNION ALL SELECT site || p, w || arg_min(html, page_id) FROM ip, (VALUES {', '.join(f"('{p}', '{w}')" for p, _, w in IR_FETCHES)}) v(p, w) GROUP BY site, p, w),
fc AS (SELECT url, arg_min(html, (length(html), md5(html))) AS content FROM fe GROUP BY url),
un AS (SELECT site, url, text, 'navigation' AS method, 0 AS ch, pos FROM nav UNION ALL SELECT site, url, text, 'search_index', 1, pos FROM sr
 UNION ALL SELECT DISTINCT site, site || p, m, 'url_pattern', 2, o FROM ip, (VALUES ('/investor-relations', '/investor-relations', 2), ('/investor-relations', '/investor-relations/', 3), ('/shareholder', '/shareholder', 14)) v(p, m, o)),
uq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY ch, pos, text) AS d FROM un) WHERE d = 1 AND regexp_extract(url, '^https?://[^/?#]*?([^./]+\\.[^./?#]+)(/|$|\\?)', 1) = regexp_extract(site, '([^./]+\\.[^./]+)$', 1)),
c8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ch, pos, url) AS n FROM uq)),
sc AS (SELECT site, CAST(n AS INTEGER) AS n, c8.url, text, method, CAST({_first_sql('lower(c8.url)', D.URL_WEIGHTS)} + {_first_sql('lower(text)', D.ANCHOR_WEIGHTS)} + {_signals_sql("lower(coalesce(content, ''))")}
 + CASE method WHEN 'navigation' THEN 5 WHEN 'search_index' THEN 3 ELSE 0 END AS INTEGER) AS score FROM c8 LEFT JOIN fc ON fc.url = c8.url)"""
CONF = "CASE WHEN score >= 70 THEN 'very_high' WHEN score >= 50 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END"


@query("score_ir_candidate", f"WITH {SCORE_SQL} SELECT site, n, url, method, score FROM sc")
def score_ir_candidate(spark, folder):
    channels, f = _ranked(spark, folder)
    return D.ranked_candidates(channels, f).select("site", "n", "url", "method", "score")


@query("confidence_class", f"WITH {SCORE_SQL} SELECT {CONF} AS confidence, count(*) AS n FROM sc GROUP BY 1")
def confidence_class(spark, folder):
    channels, f = _ranked(spark, folder)
    return D.ranked_candidates(channels, f).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


BEST_SQL = f"{SCORE_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, n) AS b FROM sc) WHERE b = 1)"


@query("discover_ir_page", f"WITH {BEST_SQL} SELECT site, url, method, score, {CONF} AS confidence FROM best")
def discover_ir_page(spark, folder):
    channels, f = _ranked(spark, folder)
    return D.discover_ir_page(channels, f).select("site", "url", "method", "score", "confidence")


KIND_SQL = "CASE " + " ".join(f"WHEN {has_any(HAY, ws)} THEN '{n}'" for n, ws in D.DOCUMENT_RULES) + " END"


@query("classify_document", f"WITH {ANCHOR_SQL} SELECT page_id, pos, {KIND_SQL} AS doc_type FROM ab")
def classify_document(spark, folder):
    return anchors(spark, folder).select("page_id", "pos", D.classify_document("text", "href").alias("doc_type"))


PERIODS = ("FY2023-24 results", "Results FY 24 Q3", "fy99 H1", "Year FY2022", "Report 2019-20", "In 2021 and 9m", "Since 2031", "Nothing here", "fy – 2020 – 21 q1", "FY07Q2 2018")
PERIOD_SQL = """pe AS (SELECT doc_id, upper(replace(replace(t, '–', '-'), '—', '-')) AS t FROM (SELECT doc_id, [""" + ", ".join(f"'{p}'" for p in PERIODS) + r"""][doc_id % 10 + 1] || ' ' || lang AS t FROM documents)),
pf AS (SELECT doc_id, nullif(regexp_extract(t, '\b(Q[1-4]|H[12]|9M)\b', 1), '') AS quarter, regexp_extract(t, 'FY\s*(\d{4})\s*-\s*(\d{2})', ['a', 'b']) AS r1, regexp_extract(t, 'FY\s*(\d{2})\b', 1) AS s1,
 regexp_extract(t, 'FY\s*(\d{4})\b', 1) AS f1, regexp_extract(t, '(\d{4})\s*-\s*(\d{2})\b', ['a', 'b']) AS r2, regexp_extract(t, '\b(20[12]\d)\b', 1) AS b1 FROM pe),
pd AS (SELECT doc_id, quarter, CAST(CASE WHEN r1.a <> '' THEN left(r1.a, 2) || r1.b WHEN s1 <> '' THEN CASE WHEN CAST(s1 AS INTEGER) < 50 THEN '20' ELSE '19' END || s1 WHEN f1 <> '' THEN f1 WHEN r2.a <> '' THEN left(r2.a, 2) || r2.b END AS INTEGER) AS fy,
 CASE WHEN CAST(nullif(b1, '') AS INTEGER) BETWEEN 2018 AND 2030 THEN CAST(b1 AS INTEGER) END AS bare FROM pf)"""


@query("extract_period", f"WITH {PERIOD_SQL} SELECT doc_id, 'FY' || fy AS financial_year, quarter, coalesce(fy - 1, bare) AS calendar_year FROM pd")
def extract_period(spark, folder):
    t = "concat(element_at(array(" + ", ".join(f"'{p}'" for p in PERIODS) + "), cast(doc_id % 10 + 1 as int)), ' ', lang) AS t"
    return table(spark, folder, "documents").selectExpr("doc_id", t).select("doc_id", D.extract_period("t").alias("p")).select("doc_id", "p.*")


DOC_TYPE_SQL = f"coalesce({KIND_SQL}, CASE WHEN {has_any(HAY, D.REPORT_KEYWORDS)} THEN 'annual_report' END)"
DOC_SQL = f"""{ANCHOR_SQL}, dc AS (SELECT page_id, site, url AS page, pos, absolute_url AS url, CASE WHEN text <> '' THEN text ELSE regexp_extract(href, '([^/]*)$', 1) END AS title, {DOC_TYPE_SQL} AS doc_type,
 CASE WHEN contains(href, 'FY2023-24') THEN 2023 WHEN contains(href, 'fy24') THEN 2023 WHEN contains(href, '2021') THEN 2021 WHEN contains(text, '2020') THEN 2020 END AS year,
 CASE WHEN contains(href, 'Q2') THEN 'Q2' WHEN contains(text, 'H1') THEN 'H1' END AS quarter, CASE WHEN blocked THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence
 FROM ab WHERE contains(lower(href), 'pdf') AND {DOC_TYPE_SQL} IS NOT NULL)"""


@query("scan_documents_on_page", f"WITH {DOC_SQL} SELECT page_id, pos, url, title, doc_type, year, quarter, confidence FROM dc")
def scan_documents_on_page(spark, folder):
    return D.scan_documents_on_page(anchors(spark, folder), ["page_id"]).select("page_id", "pos", "url", "title", "doc_type", "year", "quarter", "confidence")


PRIO_SQL = "greatest(0, " + ", ".join(f"CASE WHEN contains({HAY}, '{k}') THEN {n} ELSE 0 END" for k, n in D.SUBPAGE_PRIORITIES) + ")"


@query("subpage_priority", f"WITH {ANCHOR_SQL} SELECT page_id, pos, CAST({PRIO_SQL} AS INTEGER) AS priority FROM ab")
def subpage_priority(spark, folder):
    return anchors(spark, folder).select("page_id", "pos", D.subpage_priority().alias("priority"))


def crawl(spark, folder):
    """Crawled pages with their canonical URL, and investor pages: the first page of every site."""
    a = anchors(spark, folder).withColumn("page", U.canonicalize_url("page_url"))
    first = ir_pages(spark, folder).groupBy("site").agg(F.min_by("url", "page_id").alias("url")).withColumn("url", U.canonicalize_url("url"))
    return first, materialize(a.drop("site"), "anchors")


SUBPAGE_SQL = f"""{DOC_SQL}, fp AS (SELECT site, {canon('arg_min(url, page_id)')} AS page FROM ip GROUP BY site),
sa AS (SELECT fp.site, {canon('absolute_url')} AS url, {PRIO_SQL} AS pr, ab.page_id, pos FROM fp JOIN ab ON {canon('ab.url')} = fp.page
 WHERE {PRIO_SQL} > 0 AND NOT ends_with(lower(href), '.pdf') AND href NOT LIKE 'https://cdn.other.org%' AND {canon('absolute_url')} <> fp.page),
sb AS (SELECT site, url, max(pr) AS pr, arg_min(pos, (-pr, pos)) AS pos FROM sa GROUP BY ALL),
sv AS (SELECT site, url, CAST(row_number() OVER (PARTITION BY site ORDER BY pr DESC, pos) AS INTEGER) AS visit FROM sb)"""


@query("subpages", f"WITH {SUBPAGE_SQL} SELECT site, url, visit FROM sv")
def subpages(spark, folder):
    first, a = crawl(spark, folder)
    return D.subpages(a.join(first.select("site", F.col("url").alias("page")), "page")).select("site", "url", "visit")


FOUND_SQL = f"""{SUBPAGE_SQL}, vi AS (SELECT site, page, 0 AS visit FROM fp UNION ALL SELECT site, url, visit FROM sv),
dv AS (SELECT vi.site, visit, pos, {canon('dc.url')} AS url, doc_type, year FROM dc JOIN vi ON {canon('dc.page')} = vi.page),
du AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY visit, pos) AS d FROM dv) WHERE d = 1),
dd AS (SELECT site, url, doc_type, year, CAST(row_number() OVER (PARTITION BY site ORDER BY CASE doc_type WHEN 'annual_report' THEN 0 WHEN 'quarterly_result' THEN 1 WHEN 'financial_statement' THEN 2 WHEN 'investor_presentation' THEN 3 WHEN 'earnings_call_transcript' THEN 4 ELSE 9 END,
 -coalesce(year, 0), visit, pos, url) AS INTEGER) AS rank FROM du)"""


@query("discover_documents", f"WITH {FOUND_SQL} SELECT site, url, doc_type, year, rank FROM dd")
def discover_documents(spark, folder):
    first, a = crawl(spark, folder)
    return D.discover_documents(first, a).select("site", "url", "doc_type", "year", "rank")


@query("discover_and_collect", f"""WITH {FOUND_SQL} SELECT site, url, doc_type, year FROM dd
UNION ALL SELECT DISTINCT site, site || '/docs/annual-report-' || (2015 + page_id % 10) || '.pdf', 'annual_report', CAST(CASE WHEN 2015 + page_id % 10 >= 2018 THEN 2015 + page_id % 10 END AS INTEGER) FROM ip WHERE site NOT IN (SELECT site FROM dd)""")
def discover_and_collect(spark, folder):
    first, a = crawl(spark, folder)
    results = search_results(spark, folder).withColumn("href", F.regexp_replace("href", r"\?utm_medium=s$", ""))
    return D.discover_and_collect(first, a, sites(spark, folder), results).select("site", "url", "doc_type", "year")
