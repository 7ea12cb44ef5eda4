"""Queries over landed files, filings and the registry.

Orders are filings of a customer, who is a company; landed JSON and HTML is written by
Spark from the rows in documents of bounded size.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from ledgerloom.catalog.bindings import FIN_SQL, cents, cents_sql, financials
from ledgerloom.catalog.registry import query
from ledgerloom.operators import registry as G
from ledgerloom.session import shared_dir
from ledgerloom.sources import documents as D
from ledgerloom.sources import filings as S
from ledgerloom.sources import universe as U
from ledgerloom.sources.snapshots import SnapshotTable
from ledgerloom.tables import table

AS_OF = datetime.date(2000, 6, 30)


# --- landed files -----------------------------------------------------------------

def landing(spark, folder):
    """Files as the binaryFile source gives them: pages, turns and documents of the tables."""
    pages = table(spark, folder, "pages").selectExpr(
        "concat('landing/p', page_id, case page_id % 3 when 0 then '.html' when 1 then '.HTM' else '' end) AS path",
        "encode(if(page_id % 25 = 0, '', html), 'utf-8') AS content")
    turns = table(spark, folder, "conversations").selectExpr(
        "concat('landing/c', conv_id, '_', turn, if(turn % 2 = 0, '.json', '')) AS path", "encode(to_json(struct(role, text)), 'utf-8') AS content")
    docs = table(spark, folder, "documents").selectExpr(
        "concat('landing/d', doc_id, if(doc_id % 2 = 0, '.txt', '')) AS path", "encode(concat(if(doc_id % 4 = 1, '%PDF-1.7 ', ''), text), 'utf-8') AS content")
    return pages.unionByName(turns).unionByName(docs).withColumn("length", F.octet_length("content").cast("long"))


@query("scan_documents", """WITH f AS (SELECT 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.HTM' ELSE '' END AS name, 'html' AS t, page_id % 25 = 0 AS empty,
  CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.htm' ELSE '' END AS suffix FROM pages
 UNION ALL SELECT 'c' || conv_id || '_' || turn || CASE WHEN turn % 2 = 0 THEN '.json' ELSE '' END, 'json', false, CASE WHEN turn % 2 = 0 THEN '.json' ELSE '' END FROM conversations
 UNION ALL SELECT 'd' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '' END, CASE WHEN doc_id % 4 = 1 THEN 'pdf' WHEN regexp_matches(text, '^\\s*<') THEN 'html' WHEN regexp_matches(text, '^\\s*[\\[{]') THEN 'json' END,
  text = '' AND doc_id % 4 <> 1, CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '' END FROM documents)
SELECT 'landing/' || name AS path, CASE WHEN NOT empty THEN t END AS file_type, NOT empty AND t IS NOT NULL AS success,
 CASE WHEN empty THEN 'File is empty: landing/' || name WHEN t IS NULL THEN 'Unsupported file type: ' || suffix || ' (' || name || ')' END AS error FROM f""")
def scan_documents(spark, folder):
    return D.scan_documents(landing(spark, folder)).select("path", "file_type", "success", "error")


def unescape_sql(e):
    for a, b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        e = f"replace({e}, '{a}', '{b}')"
    return f"regexp_replace({e}, '&amp;?', '&', 'g')"


HTML_SQL = rf"""ht AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '<x>', 'g'), '<[^>]*$', '<x>'), '<[^>]*>'),
 lambda s: trim({unescape_sql('s')}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), lambda s: s <> '') AS ns FROM pages),
hl AS (SELECT page_id, string_split(array_to_string(ns, chr(10)), chr(10)) AS ls FROM ht)"""


PACK_SQL = f"""{HTML_SQL}, pk0 AS (SELECT page_id, ls, list_reduce(list_transform(ls, lambda l: CAST(length(l) + 1 AS BIGINT)),
  lambda acc, n: CASE WHEN acc % 1000000 + n >= 4000 THEN (acc // 1000000 + 1) * 1000000 ELSE acc + n END, CAST(0 AS BIGINT)) AS acc FROM hl),
pk AS (SELECT page_id, ls, acc // 1000000 + CASE WHEN acc % 1000000 > 0 THEN 1 ELSE 0 END AS pages FROM pk0)"""


@query("html_to_pages", f"""WITH {PACK_SQL} SELECT page_id, pages, md5(regexp_replace(array_to_string(ls, ''), '\\s', '', 'g')) AS digest FROM pk""")
def html_to_pages(spark, folder):
    p = D.html_to_pages(table(spark, folder, "pages"), ["page_id"])
    g = p.groupBy("page_id").agg(F.count(F.lit(1)).alias("pages"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("t"))
    return g.select("page_id", "pages", F.md5(F.regexp_replace(F.array_join("t.text", ""), r"\s", "")).alias("digest"))


@query("html_page_sizes")
def html_page_sizes(spark, folder):
    return D.html_to_pages(table(spark, folder, "pages"), ["page_id"]).select("page_id", "page", "char_count")


@query("extraction_summary", f"""WITH {PACK_SQL} SELECT 'p' || page_id AS document_id, 'html' AS file_type, true AS success, pages AS total_pages FROM pk""")
def extraction_summary(spark, folder):
    files = table(spark, folder, "pages").select(F.concat(F.lit("p"), "page_id").alias("document_id"), "html",
                                                 F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("path"), F.encode("html", "utf-8").alias("content"))
    scanned = D.scan_documents(files)
    pages = D.html_to_pages(scanned.where("success"), ["document_id"])
    return D.extraction_summary(pages, scanned).select("document_id", "file_type", "success", "total_pages")


@query("json_statement_to_text", f"""WITH {FIN_SQL} SELECT company, year, 'Period: ' || year || '-12-31' || chr(10) || 'Total Revenue: ' || format('{{:,.2f}}', {cents_sql('revenue')}) || chr(10)
 || CASE WHEN ebitda IS NULL THEN '' ELSE 'Ebitda 2X R&D: ' || format('{{:,.2f}}', {cents_sql('ebitda')}) || chr(10) END || 'Source Name: filed' || chr(10) || 'Line Count: ' || format('{{:,.2f}}', shares_outstanding / 10) AS text FROM fin""")
def json_statement_to_text(spark, folder):
    fin = financials(spark, folder).selectExpr("company", "year", """concat('{"period":"', year, '-12-31","total_revenue":', cast(floor(revenue * 100 + 0.5D) / 100 as decimal(20,2)), ',"ebitda_2x_r&d":',
          coalesce(cast(cast(floor(ebitda * 100 + 0.5D) / 100 as decimal(20,2)) as string), 'null'), ',"source_name":"filed","line_count":', cast(shares_outstanding / 10 as int), '}') AS json""")
    return fin.select("company", "year", D.json_statement_to_text("json").alias("text"))


PAYLOAD = "doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'Application/PDF; x' ELSE 'text/html' END AS content_type"


@query("valid_pdf_payload", f"""WITH p AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '%PDF-1.4 ' || text WHEN doc_id % 4 = 1 THEN '%PDFX ' || text ELSE text END AS body FROM (SELECT {PAYLOAD} FROM documents))
SELECT doc_id, contains(lower(content_type), 'pdf') AND strlen(body) >= 800 AND starts_with(body, '%PDF') AS exchange_ok,
 starts_with(body, '%PDF-') OR (contains(lower(content_type), 'application/pdf') AND strlen(body) > 1024) AS ir_ok FROM p""")
def valid_pdf_payload(spark, folder):
    d = table(spark, folder, "documents").selectExpr(*PAYLOAD.split(", ", 2)).selectExpr(
        "doc_id", "content_type", "encode(case when doc_id % 2 = 0 then concat('%PDF-1.4 ', text) when doc_id % 4 = 1 then concat('%PDFX ', text) else text end, 'utf-8') AS content")
    return d.select("doc_id", D.valid_pdf_payload().alias("exchange_ok"), D.valid_ir_pdf().alias("ir_ok"))


# --- CIK reference, submissions, facts --------------------------------------------

def cik_reference(spark, folder):
    """Reference files of fifty companies each; some tickers occur twice."""
    s = table(spark, folder, "supplier").selectExpr(
        "s_suppkey div 50 AS file_no", "s_suppkey", "named_struct('cik_str', s_suppkey + 1000, 'ticker', concat('s', s_suppkey - s_suppkey % 2), 'title', s_name) AS e")
    files = s.groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey"), F.col("e")))).alias("l"))
    return files.select("file_no", F.to_json(F.map_from_entries(F.transform("l", lambda x: F.struct(x["s_suppkey"].cast("string"), x["e"])))).alias("json"))


CIK_SQL = "ck AS (SELECT 'S' || (s_suppkey - s_suppkey % 2) AS ticker, lpad(CAST(max(s_suppkey) + 1000 AS VARCHAR), 10, '0') AS cik, max_by(s_name, s_suppkey) AS name FROM supplier GROUP BY 1)"


@query("load_cik_reference", f"WITH {CIK_SQL} SELECT * FROM ck")
def load_cik_reference(spark, folder):
    return S.load_cik_reference(cik_reference(spark, folder))


@query("resolve_cik", f"WITH {CIK_SQL}, t AS (SELECT c_custkey, 'S' || (c_custkey % 300) AS ticker FROM customer) SELECT c_custkey, t.ticker, cik, name, cik IS NOT NULL AS found FROM t LEFT JOIN ck USING (ticker)")
def resolve_cik(spark, folder):
    asked = table(spark, folder, "customer").selectExpr("c_custkey", "concat(' s', c_custkey % 300) AS ticker")
    return S.resolve_cik(asked, S.load_cik_reference(cik_reference(spark, folder))).select("c_custkey", "ticker", "cik", "name", "found")


@query("exchange_route", f"""WITH {CIK_SQL}, t AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN 'S' || (c_custkey % 300) END AS ticker FROM customer)
SELECT c_custkey, CASE WHEN ticker IS NULL OR c_custkey % 17 = 0 THEN 'unknown' WHEN cik IS NOT NULL THEN 'us' ELSE 'in' END AS exchange_group FROM t LEFT JOIN ck USING (ticker)""")
def exchange_route(spark, folder):
    """Some customers have no ticker, the look-up of some failed."""
    asked = table(spark, folder, "customer").selectExpr("c_custkey", "if(c_custkey % 11 = 0, ' ', concat(' s', c_custkey % 300)) AS ticker", "if(c_custkey % 17 = 0, true, null) AS failed")
    return U.exchange_route(asked, S.load_cik_reference(cik_reference(spark, folder)), failed="failed").select("c_custkey", "exchange_group")


FORM = "CASE o_orderkey % 9 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '8-K' WHEN 3 THEN '10-K/A' WHEN 4 THEN 'S-8' WHEN 5 THEN '20-F' WHEN 6 THEN '10-Q/A' WHEN 7 THEN '8-K/A' ELSE '10-Q' END"


def submissions(spark, folder):
    """Column-array filing documents of a company, at most 1024 order keys in each."""
    o = table(spark, folder, "orders").selectExpr(
        "lpad(cast(o_custkey as string), 10, '0') AS cik", "o_orderkey div 1024 AS file_no", "o_orderkey AS k", f"{FORM} AS form",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS fd", "if(o_orderkey % 5 = 0, null, date_format(o_orderdate, 'yyyy-MM-01')) AS rd",
        "concat(lpad(cast(o_orderkey as string), 10, '0'), '-00-1') AS acc", "concat('f', o_orderkey, '.htm') AS doc", "if(o_orderkey % 3 = 0, '', o_orderpriority) AS descr")
    g = o.groupBy("cik", "file_no").agg(F.array_sort(F.collect_list(F.struct("k", "form", "fd", "rd", "acc", "doc", "descr"))).alias("l"))
    return g.select("cik", "file_no", F.to_json(F.struct(F.struct(F.struct(
        F.col("l.form").alias("form"), F.col("l.fd").alias("filingDate"), F.col("l.rd").alias("reportDate"), F.col("l.acc").alias("accessionNumber"),
        F.col("l.doc").alias("primaryDocument"), F.col("l.descr").alias("primaryDocDescription")).alias("recent")).alias("filings"))).alias("json"))


SUB_SQL = f"""su AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, o_custkey, o_orderkey, {FORM} AS form, strftime(o_orderdate, '%Y-%m-%d') AS filing_date,
 CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-01') END AS report_date, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-00-1' AS accession,
 'f' || o_orderkey || '.htm' AS primary_doc, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS primary_doc_description FROM orders),
sk AS (SELECT *, CAST(row_number() OVER (PARTITION BY cik, form ORDER BY o_orderkey) AS INTEGER) AS form_rank,
 'https://www.sec.gov/Archives/edgar/data/' || ltrim(cik, '0') || '/' || replace(accession, '-', '') || '/' || primary_doc AS doc_url,
 CASE WHEN form IN ('10-K', '10-K/A', '20-F') THEN 'annual_report' WHEN form IN ('10-Q', '10-Q/A') THEN 'quarterly_report' ELSE 'announcement' END AS doc_type FROM su WHERE form <> 'S-8')"""
SUB_COLUMNS = "cik, form, form_rank, filing_date, report_date, accession, primary_doc, primary_doc_description, doc_url, doc_type"


@query("flatten_submissions", f"WITH {SUB_SQL} SELECT {SUB_COLUMNS} FROM sk")
def flatten_submissions(spark, folder):
    return S.flatten_submissions(submissions(spark, folder))


@query("get_annual_filings", f"WITH {SUB_SQL} SELECT {SUB_COLUMNS} FROM sk WHERE doc_type = 'annual_report'")
def get_annual_filings(spark, folder):
    return S.annual_filings(submissions(spark, folder))


@query("get_quarterly_filings", f"WITH {SUB_SQL} SELECT {SUB_COLUMNS} FROM sk WHERE doc_type = 'quarterly_report'")
def get_quarterly_filings(spark, folder):
    return S.quarterly_filings(submissions(spark, folder))


@query("sec_stored_files", f"""WITH {SUB_SQL} SELECT cik, CASE doc_type WHEN 'annual_report' THEN 'annual_reports' ELSE 'quarterly_reports' END AS kind, primary_doc AS file_name,
 coalesce(nullif(primary_doc_description, ''), form) AS headline, form AS category, accession AS news_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey + 900 ELSE 0 END AS bytes, o_orderkey % 4 <> 0 AS saved
 FROM sk WHERE doc_type IN ('annual_report', 'quarterly_report')""")
def sec_stored_files(spark, folder):
    sub = submissions(spark, folder)
    filings = S.annual_filings(sub).unionByName(S.quarterly_filings(sub))
    payloads = table(spark, folder, "orders").where("o_orderkey % 4 <> 0").selectExpr(
        "lpad(cast(o_custkey as string), 10, '0') AS cik", "concat(lpad(cast(o_orderkey as string), 10, '0'), '-00-1') AS accession", "o_custkey + 900 AS bytes")
    return S.sec_stored_files(filings, payloads).select("cik", "kind", "file_name", "headline", "category", "news_id", "bytes", "saved")


@query("xbrl_company_facts", f"""WITH {FIN_SQL} SELECT 'T' || company AS cik, 'us-gaap' AS taxonomy, 'Revenues' AS concept, 'USD' AS unit, year || '-12-31' AS "end", {cents_sql('revenue')} AS val, CAST(year AS INTEGER) AS fy, '10-K' AS form FROM fin
UNION ALL SELECT 'T' || company, 'dei', 'Shares', 'shares', year || '-06-30', shares_outstanding, CAST(year AS INTEGER), '10-Q' FROM fin""")
def xbrl_company_facts(spark, folder):
    """Company-facts documents with one point per fiscal year of two concepts."""
    fin = financials(spark, folder)
    def point(end, value, form):
        return F.struct(F.concat("year", F.lit(end)).alias("end"), value.alias("val"), F.col("year").alias("fy"), F.lit(form).alias("form"))
    def body(points, unit):
        return F.struct(F.lit("x").alias("label"), F.create_map(F.lit(unit), points).alias("units"))
    g = fin.groupBy("company").agg(F.collect_list(point("-12-31", cents("revenue"), "10-K")).alias("r"),
                                   F.collect_list(point("-06-30", F.col("shares_outstanding"), "10-Q")).alias("s"))
    raw = g.select(F.concat(F.lit("T"), "company").alias("cik"), F.to_json(F.struct(F.create_map(
        F.lit("us-gaap"), F.create_map(F.lit("Revenues"), body(F.col("r"), "USD")),
        F.lit("dei"), F.create_map(F.lit("Shares"), body(F.col("s"), "shares"))).alias("facts"))).alias("json"))
    return S.xbrl_company_facts(raw)


@query("load_announcements", """WITH pg AS (SELECT l_orderkey, l_linenumber AS page, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT *, sum(n) OVER w AS so_far FROM pg WINDOW w AS (PARTITION BY l_orderkey ORDER BY page)),
t AS (SELECT *, coalesce(max(CASE WHEN so_far >= l_orderkey % 5 + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM s)
SELECT l_orderkey AS scrip, page, n FROM t WHERE stopped = 0""")
def load_announcements(spark, folder):
    """Announcement pages of an order: one per line number, stating a row count."""
    li = table(spark, folder, "lineitem")
    pages = li.groupBy("l_orderkey", "l_linenumber").agg(F.collect_list(F.struct(
        F.col("l_partkey").cast("string").alias("NEWSID"), F.lit("1").alias("PDFFLAG"))).alias("Table"))
    raw = pages.select(F.col("l_orderkey").alias("scrip"), F.col("l_linenumber").alias("page"), F.to_json(F.struct(
        "Table", F.array(F.struct((F.col("l_orderkey") % 5 + 1).alias("ROWCNT"))).alias("Table1"))).alias("json"))
    return S.load_announcements(raw).groupBy("scrip", "page").agg(F.count(F.lit(1)).alias("n"))


@query("parse_company_search", """WITH h AS (SELECT s_suppkey // 20 AS q, s_suppkey - s_suppkey % 20 + (s_suppkey % 20) % 15 AS code, s_suppkey % 20 AS pos, s_suppkey FROM supplier),
f AS (SELECT q, code, min(pos) AS pos, min_by(s_suppkey, pos) AS sk FROM h GROUP BY q, code),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY pos) AS INTEGER) AS rank FROM f)
SELECT 'q' || q AS query, rank, CAST(code AS VARCHAR) AS code, 'Name ' || sk AS name, CASE WHEN q % 3 = 2 OR sk % 4 = 0 THEN CAST(code AS VARCHAR) ELSE 'SY' || sk END AS symbol,
 CASE WHEN q % 3 = 2 THEN '' ELSE 'IN' || sk END AS isin FROM r""")
def parse_company_search(spark, folder):
    """Search answers listing twenty companies each; every third lacks the full markup."""
    s = table(spark, folder, "supplier").selectExpr(
        "concat('q', s_suppkey div 20) AS query", "s_suppkey", """concat('<li onclick="liclick(''', s_suppkey - s_suppkey % 20 + (s_suppkey % 20) % 15, ''',''Name ', s_suppkey, ''')">',
          if((s_suppkey div 20) % 3 = 2, 'x', concat('<span><strong>', if(s_suppkey % 4 = 0, ' ', concat('SY', s_suppkey)), '</strong>&nbsp;&nbsp;&nbsp;IN', s_suppkey, '&nbsp;&nbsp;&nbsp;', 500000 + s_suppkey, '</span>')), '</li>') AS li""")
    docs = s.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "li"))).alias("l"))
    return S.parse_company_search(docs.select("query", F.array_join("l.li", "\n").alias("html")))


NAMES = """concat(o_orderpriority, ' & Co: "', o_orderstatus, '"--x') AS headline"""


@query("filing_names", r"""WITH n AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority || ' & Co: "' || o_orderstatus || '"--x' AS headline, '\a_' || o_orderkey || '-doc name.PDF.pdf' AS att FROM orders),
s AS (SELECT *, trim(regexp_replace(regexp_replace(replace(headline, '&', 'and'), '[^a-zA-Z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '-') AS sl, regexp_replace(trim(ltrim(att, '\')), '(?i)\.pdf\.pdf$', '.pdf') AS ca FROM n)
SELECT o_orderkey, left(sl, 72) AS slug, 'C' || o_custkey || '-X' AS folder, ca AS attachment,
 strftime(o_orderdate, '%Y-%m-%d') || '_' || left(sl, 52) || '_' || right(left(regexp_replace(regexp_replace(ca, '(?i)\.pdf$', ''), '[^a-zA-Z0-9._-]+', '-', 'g'), 16), 12) || '.pdf' AS file_name,
 'TK' || o_custkey || '_quarterly_report_' || year(o_orderdate) || '_Q' || quarter(o_orderdate) || '_sec' AS document_id FROM s""")
def filing_names(spark, folder):
    o = table(spark, folder, "orders").selectExpr(
        "o_orderkey", "o_custkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS d", "year(o_orderdate) AS y", NAMES, r"concat('\\a_', o_orderkey, '-doc name.PDF.pdf ') AS att", "concat('c', o_custkey, ' x') AS sym", "concat('tk', o_custkey) AS tk")
    o = o.withColumn("attachment", S.clean_attachment_name("att")).withColumn("q", S.quarter_of("d"))
    return o.select("o_orderkey", S.slug("headline").alias("slug"), S.company_folder_name("o_custkey", "sym").alias("folder"), "attachment",
                    S.unique_file_name(F.concat("d", F.lit("T00:00")), "headline", "attachment").alias("file_name"),
                    S.document_id("tk", F.lit("quarterly_report"), "y", "q", F.lit("sec")).alias("document_id"))


# --- choice of filings ---------------------------------------------------------------

ATT = "case when o_orderkey % 11 = 0 then '' else concat('A', o_orderkey % 13, '.pdf') end"
CATEGORY = "case o_orderkey % 4 when 0 then 'Result' when 1 then 'Company Update' when 2 then 'General' else 'Result' end"


def exchange_filings(spark, folder):
    o = table(spark, folder, "orders")
    annual = o.selectExpr("o_custkey AS scrip", "o_orderkey AS pos", "year(o_orderdate) AS year", "concat('A', o_orderkey % 17, '.pdf.pdf') AS file_name")
    news = o.selectExpr("o_custkey AS scrip", "o_orderkey AS pos", "to_date(o_orderdate) AS filed_on", "cast(o_orderkey as string) AS NEWSID",
                        "if(o_orderkey % 10 = 1, 'Annual  Report out', o_orderpriority) AS HEADLINE", "cast(null as string) AS NEWSSUB", f"{CATEGORY} AS CATEGORYNAME", "'Sub' AS SUBCATNAME",
                        f"{ATT} AS ATTACHMENTNAME", "if(o_orderkey % 7 = 0, '0', '1') AS PDFFLAG", "date_format(o_orderdate, 'yyyy-MM-dd') AS DissemDT", "'' AS DT_TM", "'' AS NEWS_DT")
    payloads = o.selectExpr("o_custkey AS scrip", "o_orderkey % 17 AS n").distinct().where("(scrip * 31 + n * 7) % 5 <> 0").selectExpr(
        "scrip", "concat('A', n, '.pdf') AS attachment", "scrip + 800 AS bytes")
    return S.select_filings(annual, news, payloads, AS_OF, 2, 1, 2, 365)


def _cut_sql(source, limit):
    return f"""SELECT * FROM (SELECT *, coalesce(sum(CAST(saved AS INTEGER)) OVER (PARTITION BY scrip ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source}) WHERE before < {limit}"""


CHOICE_SQL = f"""pay AS (SELECT DISTINCT o_custkey AS scrip, 'A' || (o_orderkey % 17) || '.pdf' AS attachment FROM orders WHERE (o_custkey * 31 + o_orderkey % 17 * 7) % 5 <> 0),
ay AS (SELECT o_custkey AS scrip, CAST(year(o_orderdate) AS VARCHAR) AS year, 'A' || (max(o_orderkey) % 17) || '.pdf' AS attachment FROM orders GROUP BY ALL),
an AS (SELECT scrip, attachment, 'FY-' || year || '_Annual-Report.pdf' AS file_name, 'Filing' AS headline, (scrip, attachment) IN (SELECT (scrip, attachment) FROM pay) AS saved
 FROM (SELECT *, row_number() OVER (PARTITION BY scrip ORDER BY year DESC) AS rn FROM ay) WHERE rn <= 2),
nw AS (SELECT o_custkey AS scrip, o_orderkey AS pos, o_orderdate, {CATEGORY} AS category, CASE WHEN o_orderkey % 10 = 1 THEN 'Annual Report out' ELSE o_orderpriority END AS headline,
 'A' || (o_orderkey % 13) || '.pdf' AS attachment FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0),
q0 AS (SELECT scrip, attachment, min(pos) AS pos FROM nw WHERE category = 'Result' AND CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - 900 AND (scrip, attachment) NOT IN (SELECT (scrip, attachment) FROM an) GROUP BY ALL),
q1 AS (SELECT *, (scrip, attachment) IN (SELECT (scrip, attachment) FROM pay) AS saved FROM q0), q2 AS ({_cut_sql('q1', 1)}),
m0 AS (SELECT scrip, attachment, min(pos) AS pos FROM nw WHERE category <> 'Result' AND CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - 365 AND NOT (headline = 'Annual Report out' AND category = 'Company Update')
 AND (scrip, attachment) NOT IN (SELECT (scrip, attachment) FROM an) AND (scrip, attachment) NOT IN (SELECT (scrip, attachment) FROM q2) GROUP BY ALL),
m1 AS (SELECT *, (scrip, attachment) IN (SELECT (scrip, attachment) FROM pay) AS saved FROM m0), m2 AS ({_cut_sql('m1', 2)}),
nm AS (SELECT scrip, pos, headline, strftime(o_orderdate, '%Y-%m-%d') || '_' AS d, replace(headline, ' ', '-') AS sl, replace(attachment, '.pdf', '') AS st FROM nw),
ch AS (SELECT scrip, 'annual_reports' AS kind, attachment, file_name, headline, saved FROM an
 UNION ALL SELECT q2.scrip, 'quarterly_reports', attachment, d || sl || '_' || st || '.pdf', headline, saved FROM q2 JOIN nm ON nm.scrip = q2.scrip AND nm.pos = q2.pos
 UNION ALL SELECT m2.scrip, 'announcements', attachment, d || 'Sub-' || sl || '_' || st || '.pdf', headline, saved FROM m2 JOIN nm ON nm.scrip = m2.scrip AND nm.pos = m2.pos)"""


@query("select_filings", f"WITH {CHOICE_SQL} SELECT *, CASE WHEN saved THEN scrip + 800 ELSE 0 END AS bytes FROM ch")
def select_filings(spark, folder):
    return exchange_filings(spark, folder).select("scrip", "kind", "attachment", "file_name", "headline", "saved", "bytes")


@query("filing_counts", f"""WITH {CHOICE_SQL} SELECT scrip, count(*) FILTER (saved AND kind = 'annual_reports') AS annual_reports, count(*) FILTER (saved AND kind = 'quarterly_reports') AS quarterly_reports,
 count(*) FILTER (saved AND kind = 'announcements') AS announcements, CAST(count(*) FILTER (saved) * (scrip + 800) AS BIGINT) AS total_bytes FROM ch GROUP BY scrip""")
def filing_counts(spark, folder):
    return S.filing_counts(exchange_filings(spark, folder), ["scrip"])


MANIFEST_SQL = """SELECT c_mktsegment || '-' || c_nationkey AS folder, CAST(c_nationkey AS VARCHAR) AS scrip, count(*) AS annual_reports, count(*) FILTER (c_custkey % 3 = 0) AS total_bytes FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY ALL
UNION ALL SELECT DISTINCT c_mktsegment || '-' || c_nationkey, c_mktsegment, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM customer WHERE c_nationkey % 5 = 0"""


@query("read_manifests", MANIFEST_SQL)
@query("write_manifest", MANIFEST_SQL)
def write_manifest(spark, folder):
    """Manifests written per folder and read back with the list of all folders."""
    c = table(spark, folder, "customer")
    kept = c.where("c_nationkey % 5 <> 0").groupBy("c_mktsegment", "c_nationkey").agg(
        F.count(F.lit(1)).alias("annual_reports"), F.count_if(F.expr("c_custkey % 3 = 0")).alias("total_bytes"))
    rows = kept.select(F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("folder"), F.col("c_nationkey").cast("string").alias("scrip"), F.col("c_mktsegment").alias("symbol"),
                       F.lit("2024-01-01").alias("fetched_at"), "annual_reports", F.lit(0).cast("long").alias("quarterly_reports"), F.lit(0).cast("long").alias("announcements"), "total_bytes")
    path = f"{shared_dir(spark)}/manifests-{uuid.uuid4().hex}"
    S.write_manifest(rows, path)
    folders = c.select(F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("folder"))
    return S.read_manifests(spark, path, folders, rows.schema).select("folder", "scrip", "annual_reports", "total_bytes")


# --- registry ----------------------------------------------------------------------

def updates(spark, folder, where):
    o = table(spark, folder, "orders").where(where)
    return o.selectExpr(
        "concat('D', o_custkey, '_', o_orderkey % 3) AS document_id", "concat('t', o_custkey) AS ticker", "if(o_orderkey % 4 = 0, null, concat('Name ', o_custkey)) AS company_name",
        "case o_orderkey % 3 when 0 then 'annual_report' when 1 then 'quarterly_report' else 'announcement' end AS doc_type", "concat('Title ', o_orderkey) AS title",
        "year(o_orderdate) AS year", "concat('Q', quarter(o_orderdate)) AS quarter", "case o_orderkey % 5 when 0 then '' when 1 then null else concat('f/', o_orderkey) end AS file_path",
        "if(o_orderkey % 6 = 0, 0, o_orderkey) AS file_size", "'bse' AS source", "cast(null as string) AS source_url", "if(o_orderkey % 2 = 0, '', md5(cast(o_orderkey as string))) AS checksum_sha256",
        "o_orderstatus AS processing_status", "cast(o_orderdate as timestamp) AS updated_at", "o_orderkey AS pos")


def registry(spark, folder):
    first = updates(spark, folder, "o_orderdate < '1999-01-01'")
    none = first.drop("pos").withColumn("download_date", F.col("updated_at")).select(*G.REGISTRY_COLUMNS).limit(0)
    return G.registry_upsert(G.registry_upsert(none, first), updates(spark, folder, "o_orderdate >= '1999-01-01'"))


REG_SQL = """u AS (SELECT 'D' || o_custkey || '_' || (o_orderkey % 3) AS document_id, *, CASE WHEN o_orderdate < '1999-01-01' THEN 0 ELSE 1 END AS batch FROM orders),
o2 AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY batch, o_orderkey) AS n FROM u),
rg AS (SELECT document_id, 'T' || min_by(o_custkey, n) AS ticker, max(CASE WHEN n = 1 AND o_orderkey % 4 <> 0 THEN 'Name ' || o_custkey END) AS company_name,
 CASE min_by(o_orderkey, n) % 3 WHEN 0 THEN 'annual_report' WHEN 1 THEN 'quarterly_report' ELSE 'announcement' END AS doc_type, 'Title ' || min_by(o_orderkey, n) AS title,
 CAST(year(min_by(o_orderdate, n)) AS INTEGER) AS year, 'f/' || max_by(o_orderkey, n) FILTER (o_orderkey % 5 NOT IN (0, 1)) AS file_path,
 max_by(o_orderkey, n) FILTER (o_orderkey % 6 <> 0) AS file_size, md5(CAST(max_by(o_orderkey, n) FILTER (o_orderkey % 2 <> 0) AS VARCHAR)) AS checksum_sha256,
 max_by(o_orderstatus, n) AS processing_status, max_by(o_orderdate, n) AS updated_at FROM o2 GROUP BY document_id)"""
REG_COLUMNS = ["document_id", "ticker", "company_name", "doc_type", "title", "year", "file_path", "file_size", "checksum_sha256", "processing_status", "updated_at"]


@query("registry_upsert", f"WITH {REG_SQL} SELECT document_id, ticker, company_name, doc_type, title, year, coalesce(file_path, '~') AS file_path, coalesce(file_size, -1) AS file_size, coalesce(checksum_sha256, '~') AS checksum_sha256, processing_status, updated_at FROM rg")
def registry_upsert(spark, folder):
    r = registry(spark, folder).select(*REG_COLUMNS)
    return r.withColumns({"file_path": F.coalesce("file_path", F.lit("~")), "file_size": F.coalesce("file_size", F.lit(-1)), "checksum_sha256": F.coalesce("checksum_sha256", F.lit("~"))})


@query("stored_registry_upsert", f"WITH {REG_SQL} SELECT document_id, ticker, company_name, doc_type, year, coalesce(file_path, '~') AS file_path, processing_status, updated_at FROM rg")
def stored_registry_upsert(spark, folder):
    """The same two batches folded into a registry kept in versions."""
    first, second = updates(spark, folder, "o_orderdate < '1999-01-01'"), updates(spark, folder, "o_orderdate >= '1999-01-01'")
    schema = first.drop("pos").withColumn("download_date", F.col("updated_at")).select(*G.REGISTRY_COLUMNS).schema
    kept = SnapshotTable(spark, f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}", schema, ["document_id"], 16)
    for rows in (first, second):
        G.store_updates(kept, rows)
    return kept.read().select("document_id", "ticker", "company_name", "doc_type", "year", F.coalesce("file_path", F.lit("~")).alias("file_path"), "processing_status", "updated_at")


@query("list_documents", f"""WITH {REG_SQL} SELECT document_id, ticker, doc_type, year,
 coalesce(first_value(company_name) OVER (PARTITION BY ticker ORDER BY year DESC, doc_type, document_id), ticker) AS company, count(*) OVER (PARTITION BY ticker) AS total_documents FROM rg""")
def list_documents(spark, folder):
    return G.list_documents(registry(spark, folder), year=0).select("document_id", "ticker", "doc_type", "year", "company", "total_documents")


@query("get_document", f"WITH {REG_SQL} SELECT document_id, title FROM rg WHERE document_id = 'D7_1'")
def get_document(spark, folder):
    return G.get_document(registry(spark, folder), "D7_1").select("document_id", "title")


def _exists_sql(word):
    return f"WITH {REG_SQL}, c AS (SELECT 'D' || o_custkey || '_' || (o_orderkey % 4) AS document_id, o_orderkey FROM orders) SELECT document_id, o_orderkey FROM c WHERE document_id {word} (SELECT document_id FROM rg WHERE file_path IS NOT NULL AND CAST(substr(file_path, 3) AS BIGINT) % 7 <> 0)"


def _exists(spark, folder, flag):
    files = table(spark, folder, "orders").selectExpr("concat('f/', o_orderkey) AS path", "if(o_orderkey % 7 = 0, 0, 5) AS length")
    cands = table(spark, folder, "orders").selectExpr("concat('D', o_custkey, '_', o_orderkey % 4) AS document_id", "o_orderkey")
    return G.registry_exists(cands, registry(spark, folder), files, flag).select("document_id", "o_orderkey")


query("registry_exists", _exists_sql("IN"))(lambda spark, folder: _exists(spark, folder, True))
query("registry_missing", _exists_sql("NOT IN"))(lambda spark, folder: _exists(spark, folder, False))


@query("documents_by_type", f"WITH {REG_SQL} SELECT ticker, doc_type, count(*) AS documents FROM rg GROUP BY ALL")
def documents_by_type(spark, folder):
    return G.documents_by_type(registry(spark, folder))


@query("merge_ingestion", f"""WITH {REG_SQL}, s AS (SELECT 'T' || o_custkey AS ticker, document_id IN (SELECT document_id FROM rg WHERE processing_status = 'F') AS known, ok, src FROM (
 SELECT o_custkey, 'D' || o_custkey || '_' || (o_orderkey % 3) AS document_id, o_orderkey % 2 = 0 AS ok, 'sec_edgar' AS src FROM orders WHERE o_orderpriority < '3'
 UNION ALL SELECT o_custkey, 'D' || o_custkey || '_' || (o_orderkey % 4), true, 'bse' FROM orders WHERE o_orderpriority >= '3'))
SELECT ticker, count(*) FILTER (NOT known AND ok) AS new_documents, count(*) FILTER (known) AS existing_documents, count(*) FILTER (NOT known AND NOT ok) AS failed,
 string_agg(DISTINCT src, ',' ORDER BY src DESC) AS sources FROM s GROUP BY ticker""")
def merge_ingestion(spark, folder):
    existing = registry(spark, folder).where("processing_status = 'F'")
    o = table(spark, folder, "orders")
    sec = o.where("o_orderpriority < '3'").selectExpr("concat('t', o_custkey, ' ') AS ticker", "concat('D', o_custkey, '_', o_orderkey % 3) AS document_id", "o_orderkey % 2 = 0 AS ok")
    bse = o.where("o_orderpriority >= '3'").selectExpr("concat('T', o_custkey) AS ticker", "concat('D', o_custkey, '_', o_orderkey % 4) AS document_id", "true AS ok")
    return G.merge_ingestion([G.collect_results(sec, existing, "sec_edgar"), G.collect_results(bse, existing, "bse")])
