"""Investor-relations pages and documents in a table of crawled pages."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ledgerloom.functions import text as T
from ledgerloom.functions.urls import canonicalize_url, query_param, same_domain
from ledgerloom.operators.ordered import first_per_key, top_per_key
from ledgerloom.session import materialize

# Fixed values of the discovery rules.
BLOCK_SIGNS = ("access denied", "are you a human", "captcha", "unusual traffic", "please verify you are a human",
               "attention required", "request blocked", "bot detection", "enable javascript to continue",
               "checking your browser", "just a moment", "ddos protection by")
IR_PATTERNS = ("/investors", "/investors/", "/investor-relations", "/investor-relations/", "/investor", "/investor/",
               "/investors.html", "/investor.html", "/about/investor-relations", "/about-us/investor-relations",
               "/about/investors", "/investor-information", "/investor-centre", "/investor-center", "/shareholder",
               "/shareholders", "/financial-information")
IR_KEYWORDS = ("investor relation", "investor", "investors", "shareholder", "shareholders", "financial information",
               "investor information", "investor centre", "investor center")
STRONG_SIGNALS = (("investor relations", 10), ("investor presentation", 10), ("annual report", 10), ("financial results", 10),
                  ("quarterly results", 10), ("earnings call", 10), ("earnings transcript", 10), ("shareholding pattern", 8),
                  ("regulatory disclosure", 8))
MEDIUM_SIGNALS = (("financial statements", 5), ("corporate announcements", 5), ("investor information", 5),
                  ("shareholder information", 5), ("analyst", 4), ("corporate governance", 3))
WEAK_SIGNALS = ("dividend", "board of directors", "share price", "stock information")
URL_WEIGHTS = (("investor-relations", 40), ("investors", 35), ("investor", 30), ("shareholder", 20))
ANCHOR_WEIGHTS = (("investor relations", 30), ("investors", 25), ("investor", 20), ("shareholder", 15))
METHOD_WEIGHTS = (("navigation", 5, "found via homepage navigation"), ("search_index", 3, "found via search index"))
REPORT_KEYWORDS = ("annual report", "annual review", "integrated report", "integrated annual report", "financial results",
                   "quarterly results", "investor presentation", "earnings presentation", "quarterly report",
                   "financial statement", "annual return")
SUBPAGE_PRIORITIES = (("annual report", 10), ("annual review", 10), ("financial result", 10), ("quarterly result", 10),
                      ("earnings call", 10), ("investor presentation", 10), ("transcript", 10), ("financial statement", 8),
                      ("corporate announcement", 5), ("governance", 3), ("policies", 2))
DOCUMENT_RULES = (
    ("annual_report", ("annual report", "annual review", "integrated report", "integrated annual report", "annual return")),
    ("earnings_call_transcript", ("transcript", "earnings call transcript")),
    ("investor_presentation", ("investor presentation", "earnings presentation", "corporate presentation", "results presentation")),
    ("quarterly_result", ("quarterly result", "quarterly report")),
    ("financial_statement", ("financial result", "financial statement")),
)
TYPE_PRIORITY = (("annual_report", 0), ("quarterly_result", 1), ("financial_statement", 2), ("investor_presentation", 3),
                 ("earnings_call_transcript", 4))


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: dict | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.close_anchor()
            href = dict(attrs).get("href")
            if href is not None:
                self.open = {"href": href, "parts": [], "held": ""}
        elif self.open:
            self.cut()

    def handle_endtag(self, tag):
        if tag == "a":
            self.close_anchor()
        elif self.open:
            self.cut()

    def handle_data(self, data):
        if self.open:
            self.open["held"] += data

    def cut(self):
        self.open["parts"].append(self.open["held"].strip())
        self.open["held"] = ""

    def close_anchor(self):
        if self.open:
            self.cut()
            self.found.append({"text": "".join(self.open["parts"]), "href": self.open["href"]})
            self.open = None


def _anchors(url: str, html: str) -> list[dict]:
    parser = _Anchors()
    parser.feed(html)
    parser.close()
    parser.close_anchor()
    out = []
    for a in parser.found:
        try:
            absolute = urljoin(url, a["href"])
        except ValueError:
            absolute = a["href"]
        out.append({**a, "absolute_url": absolute})
    return out


_ANCHOR = ArrayType(StructType([StructField(n, StringType()) for n in ("text", "href", "absolute_url")]))


# Pages of any length go to Python row by row: a batch of ten thousand of them would be held several times over.
@F.udf(_ANCHOR, useArrow=False)
def _page_anchors(url: str | None, html: str | None) -> list[dict]:
    return _anchors(url or "", html) if html else []


def looks_blocked(c="html") -> Column:
    c = T.col(c)
    return F.coalesce(F.length(c) < 500, F.lit(True)) | T.any_keyword(F.lower(F.substring(c, 1, 3000)), BLOCK_SIGNS)


def extract_anchors(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Every link of every page in order: ``keys, pos, text, href, absolute_url, blocked``.

    ``keys`` are columns of ``pages``, which also has ``url`` and ``html``.
    """
    a = pages.select(*keys, "url", looks_blocked("html").alias("blocked"), F.posexplode(_page_anchors("url", "html")).alias("pos", "a"))
    rest = [k for k in keys if k != "url"]
    return a.select(*rest, F.col("url").alias("page_url"), "blocked", "pos", "a.*")


def page_status(code) -> Column:
    c = T.col(code)
    return (F.when(c.isNull(), "connection_error").when(c == 200, "accessible").when(c.isin(301, 302), "redirected")
            .when(c == 403, "blocked_403").when(c == 404, "not_found_404").when(c >= 500, "server_error").otherwise("unknown"))


def unwrap_search_url(c) -> Column:
    return F.coalesce(query_param(c, "uddg", "url", "target"), T.col(c))


def normalize_for_matching(c) -> Column:
    return T.squeeze(F.regexp_replace(F.lower(T.col(c)), "[-_+]", " "))


def _combined(text, href) -> Column:
    return normalize_for_matching(F.concat_ws(" ", F.coalesce(T.col(text), F.lit("")), F.coalesce(T.col(href), F.lit(""))))


def is_ir_link(text="text", href="href") -> Column:
    return T.any_keyword(_combined(text, href), IR_KEYWORDS)


CANDIDATE = ("site", "url", "text", "method", "pos")


def nav_candidates(anchors: DataFrame) -> DataFrame:
    """Links of a site's pages that look like investor relations; anchors carry ``site``."""
    return anchors.where(is_ir_link()).select(
        "site", canonicalize_url("absolute_url").alias("url"), "text", F.lit("navigation").alias("method"), "pos")


def search_candidates(sites: DataFrame, results: DataFrame) -> DataFrame:
    """Search-result links (site, href, text, pos) on the registrable domain of the site."""
    href = unwrap_search_url("href")
    found = results.join(sites.select("site"), "site", "left_semi").withColumn("href", href)
    return found.where(same_domain("href", "site")).select(
        "site", canonicalize_url("href").alias("url"), "text", F.lit("search_index").alias("method"), "pos")


def pattern_candidates(sites: DataFrame, fetched: DataFrame) -> DataFrame:
    """Usual paths of a site whose landed fetch (url, status) did not fail."""
    tried = sites.select("site", F.posexplode(F.array(*[F.lit(p) for p in IR_PATTERNS])).alias("pos", "text"))
    tried = tried.withColumn("url", canonicalize_url(F.concat(F.regexp_replace("site", "/+$", ""), "text")))
    ok = fetched.where(~page_status("status").isin("not_found_404", "connection_error", "server_error"))
    return (tried.join(ok.select(canonicalize_url("url").alias("url")).distinct(), "url", "left_semi")
            .select("site", "url", "text", F.lit("url_pattern").alias("method"), "pos"))


def _first_weight(c: Column, weights, what: str):
    points, note = F.lit(0), F.lit(None).cast("string")
    for word, n in reversed(weights):
        hit = F.contains(c, F.lit(word))
        points = F.when(hit, n).otherwise(points)
        note = F.when(hit, f"+{n} {what} contains '{word}'").otherwise(note)
    return points, note


def score_ir_candidate(url="url", text="text", content="content", method="method") -> Column:
    """struct(score, evidence) of a candidate; of the weak signals the first three count."""
    lower = F.lower(T.col(url))
    u, u_note = _first_weight(lower, URL_WEIGHTS, "URL")
    a, a_note = _first_weight(F.lower(F.coalesce(T.col(text), F.lit(""))), ANCHOR_WEIGHTS, "anchor")
    body = F.lower(F.coalesce(T.col(content), F.lit("")))
    strong = F.array(*[F.struct(F.lit(w).alias("n"), F.lit(f"+{w} content: '{s}'").alias("note"), F.contains(body, F.lit(s)).alias("hit"))
                       for s, w in STRONG_SIGNALS + MEDIUM_SIGNALS])
    weak = F.array(*[F.struct(F.lit(1).alias("n"), F.lit(f"+1 content (weak): '{s}'").alias("note"), F.contains(body, F.lit(s)).alias("hit"))
                     for s in WEAK_SIGNALS])
    hits = F.concat(F.filter(strong, lambda x: x["hit"]), F.slice(F.filter(weak, lambda x: x["hit"]), 1, 3))
    m, m_note = F.lit(0), F.lit(None).cast("string")
    for name, n, what in METHOD_WEIGHTS:
        m = F.when(T.col(method) == name, n).otherwise(m)
        m_note = F.when(T.col(method) == name, f"+{n} {what}").otherwise(m_note)
    total = u + a + m + F.aggregate(hits, F.lit(0), lambda acc, x: acc + x["n"])
    notes = F.array_compact(F.concat(F.array(u_note, a_note), F.transform(hits, lambda x: x["note"]), F.array(m_note)))
    return F.struct(total.alias("score"), notes.alias("evidence"))


def confidence_class(score) -> Column:
    s = T.col(score)
    return F.when(s >= 70, "very_high").when(s >= 50, "high").when(s >= 30, "medium").otherwise("low")


def ranked_candidates(channels: list[DataFrame], fetched: DataFrame, limit: int | None = None) -> DataFrame:
    """Scored candidates of every site: unique URLs in channel order, own domain if any, the first ``limit`` or all."""
    union = None
    for i, c in enumerate(channels):
        c = c.select(*CANDIDATE, F.lit(i).alias("channel"))
        union = c if union is None else union.unionByName(c)
    unique = first_per_key(union, ["site", "url"], [F.col("channel"), F.col("pos"), F.col("text")])
    unique = materialize(unique.withColumn("own", same_domain("url", "site")), "candidates")
    has_own = unique.groupBy("site").agg(F.max("own").alias("_any"))
    usable = unique.join(has_own, "site").where(F.col("own") | ~F.col("_any"))
    first = top_per_key(usable, ["site"], [F.col("channel"), F.col("pos"), F.col("url")], limit, "n")
    # Only pages that are candidates are folded.
    pages = fetched.select(canonicalize_url("url").alias("url"), F.col("html").alias("content")).join(unique.select("url").distinct(), "url", "left_semi")
    content = first_per_key(pages, ["url"], [F.length("content"), F.md5("content")])
    scored = first.join(content, "url", "left").withColumn("s", score_ir_candidate())
    return scored.select("site", "n", "url", "text", "method", "s.score", "s.evidence", confidence_class("s.score").alias("confidence"))


def discover_ir_page(channels: list[DataFrame], fetched: DataFrame) -> DataFrame:
    """Best candidate of every site; of equal scores the earlier one."""
    r = ranked_candidates(channels, fetched)
    return first_per_key(r, ["site"], [-F.col("score"), F.col("n")])


def classify_document(text, url) -> Column:
    hay = _combined(text, url)
    out = None
    for name, words in DOCUMENT_RULES:
        hit = T.any_keyword(hay, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def extract_period(c) -> Column:
    """struct(financial_year, quarter, calendar_year) named in a text."""
    t = F.translate(F.upper(T.col(c)), "–—", "--")
    none = F.lit(None).cast("int")

    def number(pattern, group=1):
        return F.try_to_number(T.truthy(F.regexp_extract(t, "(?U)" + pattern, group)), F.lit("9999")).cast("int")

    def ranged(pattern):
        first, last = number(pattern, 1), number(pattern, 2)
        return F.floor(first / 100).cast("int") * 100 + last

    short = number(r"FY\s*(\d{2})\b")
    year = F.coalesce(
        ranged(r"FY\s*(\d{4})\s*-\s*(\d{2})"), F.when(short < 50, 2000 + short).otherwise(1900 + short), number(r"FY\s*(\d{4})\b"),
        ranged(r"(\d{4})\s*-\s*(\d{2})\b"))
    bare = number(r"\b(20[12]\d)\b")
    bare = F.when((bare >= 2018) & (bare <= 2030), bare).otherwise(none)
    return F.struct(
        F.when(year.isNotNull(), F.concat(F.lit("FY"), year)).alias("financial_year"),
        T.truthy(F.regexp_extract(t, r"(?U)\b(Q[1-4]|H[12]|9M)\b", 1)).alias("quarter"),
        F.coalesce(year - 1, bare).alias("calendar_year"))


def scan_documents_on_page(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """PDF links with type, period and confidence."""
    pdf = anchors.where(F.contains(F.lower("href"), F.lit("pdf")))
    kind = F.coalesce(classify_document("text", "href"), F.when(T.any_keyword(_combined("text", "href"), REPORT_KEYWORDS), "annual_report"))
    d = pdf.withColumns({"doc_type": kind, "p": extract_period(F.concat_ws(" ", "text", "href"))}).where(F.col("doc_type").isNotNull())
    return d.select(
        *keys, "pos", F.col("absolute_url").alias("url"),
        F.coalesce(T.truthy("text"), F.regexp_extract("href", "([^/]*)$", 1)).alias("title"), "doc_type",
        F.col("p.calendar_year").alias("year"), "p.financial_year", "p.quarter",
        F.when(F.col("blocked"), 0.6).otherwise(0.9).alias("confidence"))


def subpage_priority(text="text", href="href") -> Column:
    hay = _combined(text, href)
    return F.greatest(F.lit(0), *[F.when(F.contains(hay, F.lit(k)), n) for k, n in SUBPAGE_PRIORITIES])


def subpages(ir_anchors: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages to read after the IR page of a site, best first: ``site, url, visit``.

    ``ir_anchors`` are the links of the IR pages with ``site`` and ``page_url``.
    """
    a = ir_anchors.withColumns({"url": canonicalize_url("absolute_url"), "priority": subpage_priority()})
    a = a.where((F.col("priority") > 0) & ~F.endswith(F.lower("href"), F.lit(".pdf")) & (F.col("url") != canonicalize_url("page_url"))
                & same_domain("page_url", "absolute_url"))
    best = first_per_key(a.select("site", "url", "priority", "pos"), ["site", "url"], [-F.col("priority"), F.col("pos")])
    return top_per_key(best, ["site"], [F.desc("priority"), F.col("pos")], limit, "visit").select("site", "url", "visit")


def discover_documents(ir_pages: DataFrame, anchors: DataFrame, subpage_limit: int | None = None,
                       limit: int | None = None) -> DataFrame:
    """Documents of every site: IR page first, then its subpages; unique URLs, best first, all without limits.

    ``ir_pages``: site, url (canonical); ``anchors``: links of all crawled pages with
    ``page`` (canonical URL of the page).  The links are read twice: hand in a written table.
    """
    first = ir_pages.select("site", F.col("url").alias("page"), F.lit(0).alias("visit"))
    ir_anchors = anchors.join(first.select("site", "page"), "page")
    more = subpages(ir_anchors, subpage_limit).select("site", F.col("url").alias("page"), "visit")
    visits = first.unionByName(more)
    docs = scan_documents_on_page(anchors.join(visits, "page"), ["site", "visit"])
    docs = docs.withColumn("url", canonicalize_url("url"))
    unique = first_per_key(docs, ["site", "url"], [F.col("visit"), F.col("pos")])
    return _best_documents(unique, limit)


def _best_documents(unique: DataFrame, limit: int | None) -> DataFrame:
    priority = F.lit(9)
    for name, n in TYPE_PRIORITY:
        priority = F.when(F.col("doc_type") == name, n).otherwise(priority)
    order = [priority, -F.coalesce("year", F.lit(0)), F.col("visit"), F.col("pos"), F.col("url")]
    return top_per_key(unique, ["site"], order, limit, "rank").drop("visit", "pos")


def documents_from_search(sites: DataFrame, results: DataFrame) -> DataFrame:
    """Fallback: PDF links among search results (site, href, text, pos) on the site's domain."""
    r = results.join(sites.select("site"), "site", "left_semi").withColumn("href", unwrap_search_url("href"))
    r = r.where(same_domain("href", "site") & F.endswith(F.lower("href"), F.lit(".pdf")))
    r = r.withColumns({"doc_type": classify_document("text", "href"), "p": extract_period(F.concat_ws(" ", "text", "href")), "url": canonicalize_url("href")})
    rows = r.where(F.col("doc_type").isNotNull()).select(
        "site", "url", F.coalesce(T.truthy("text"), F.regexp_extract("href", "([^/]*)$", 1)).alias("title"), "doc_type",
        F.col("p.calendar_year").alias("year"), "p.financial_year", "p.quarter", F.lit(0.7).alias("confidence"), "pos")
    return first_per_key(rows, ["site", "url"], [F.col("pos")])


def discover_and_collect(ir_pages: DataFrame, anchors: DataFrame, sites: DataFrame, results: DataFrame) -> DataFrame:
    """Documents of every site from its pages, or from search where the pages gave none."""
    found = discover_documents(ir_pages, anchors).drop("rank")
    missing = sites.select("site").distinct().join(found.select("site").distinct(), "site", "left_anti")
    return found.unionByName(documents_from_search(missing, results).drop("pos"))
