"""Queries over requests, plans, evidence, claims and reports.

A report is seven consecutive documents, one per section; the next seven documents are
its evidence.  Sentences a report would have (figures, citations) are added by rule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.catalog import retrieval as retrieval_sql
from ledgerloom.catalog.bindings import FIN_SQL, financials
from ledgerloom.catalog.finance import metric_status_sql, metric_value_sql
from ledgerloom.catalog.news import REST, REST_SQL
from ledgerloom.catalog.registry import query
from ledgerloom.catalog.retrieval import class_sql, document_chunks
from ledgerloom.functions import vectors as V
from ledgerloom.functions.numeric import plain_number
from ledgerloom.operators import evidence as E
from ledgerloom.operators import peers, planning as P, ratios
from ledgerloom.operators import reports as R
from ledgerloom.operators import retrieval
from ledgerloom.operators.ordered import last_per_key
from ledgerloom.session import materialize, release, shared_dir
from ledgerloom.sources.report_files import read_report_files, write_report_files
from ledgerloom.tables import table

TICKER = "concat('T', translate(cast({} as string), '0123456789', 'ABCDEFGHIJ'))"
TICKER_SQL = "'T' || translate(CAST({} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"

OPENERS = ("", "Compare these: ", "What are the risks for Apple and ", "Write a report on TCS, AI and ", "What is the ROE and EPS of ",
           "WIPRO vs. infosys, ", "Full analysis of CEO pay at ", "How much did HCL pay ")


def requests(spark, folder):
    opener = "element_at(array(" + ", ".join(f"'{o}'" for o in OPENERS) + "), cast(conv_id % 8 + 1 as int))"
    return table(spark, folder, "conversations").where("role = 'user'").selectExpr(
        "concat('R', conv_id, '-', turn) AS request_id",
        f"concat({opener}, {TICKER.format('conv_id % 100')}, ': ', text) AS request")


REQUEST_SQL = ("rq AS (SELECT 'R' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS request_id, ["
               + ", ".join(f"'{o}'" for o in OPENERS) + f"][conv_id % 8 + 1] || {TICKER_SQL.format('conv_id % 100')} || ': ' || text AS request "
               "FROM conversations WHERE role = 'user')")
RCLASS_SQL = class_sql("request", P.REQUEST_PATTERNS, "company_analysis")
_KNOWN_SQL = "[" + ", ".join(f"CASE WHEN contains(lower(request), '{n}') THEN '{t}' END" for n, t in P.KNOWN_COMPANIES) + "]"
_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in P.TICKER_STOPWORDS) + "]"
# One occurrence of each ticker, in the order found.  The word boundary is spelt out
# because \b is ASCII on this side.
PLAN_SQL = f"""{REQUEST_SQL}, pl0 AS (SELECT *, {RCLASS_SQL} AS request_type,
 list_concat(list_filter({_KNOWN_SQL}, lambda x: x IS NOT NULL),
  list_filter(regexp_extract_all(regexp_replace(request, '[^\\p{{L}}\\p{{N}}_]', '  ', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Z]{{2,5}})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1), lambda w: NOT list_contains({_STOP_SQL}, w))) AS found FROM rq),
pl AS (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i) AS companies FROM pl0)"""


@query("classify_request", f"WITH {REQUEST_SQL} SELECT request_id, {RCLASS_SQL} AS request_type FROM rq")
def classify_request(spark, folder):
    return requests(spark, folder).select("request_id", P.classify_request("request").alias("request_type"))


@query("extract_companies", f"WITH {PLAN_SQL} SELECT request_id, array_to_string(companies, ',') AS companies FROM pl")
def extract_companies(spark, folder):
    return requests(spark, folder).select("request_id", F.array_join(P.extract_companies("request"), ",").alias("companies"))


def plans(spark, folder):
    return P.create_plan(requests(spark, folder))


_TPL_SQL = "CASE request_type " + " ".join(
    f"WHEN '{k}' THEN [" + ", ".join(f"'{t}'" for t in v) + "]" for k, v in P.QUERY_TEMPLATES.items()) + " ELSE ['{company} overview'] END"
GENQ_SQL = f"""{PLAN_SQL}, gq AS (SELECT *, flatten(list_transform(companies, lambda c: list_transform({_TPL_SQL}, lambda t: replace(t, '{{company}}', c)))) AS qs FROM pl)"""


@query("generate_queries", f"WITH {GENQ_SQL} SELECT request_id, array_to_string(qs, '|') AS queries FROM gq")
def generate_queries(spark, folder):
    return plans(spark, folder).select("request_id", F.array_join("retrieval_queries", "|").alias("queries"))


@query("create_plan", f"""WITH {GENQ_SQL} SELECT request_id, 'REQ-' || upper(left(md5(request_id || '|' || request), 8)) AS plan_id, request_type,
 CAST(len(companies) AS INTEGER) AS n_companies, CAST(len(qs) AS INTEGER) AS n_queries,
 CASE WHEN request_type = 'factual_query' THEN 'brief_answer' ELSE 'research_report' END AS output_format FROM gq""")
def create_plan(spark, folder):
    return plans(spark, folder).select("request_id", "plan_id", "request_type", F.size("companies").alias("n_companies"),
                                       F.size("retrieval_queries").alias("n_queries"), "output_format")


def latest(spark, folder):
    """Last fiscal year of every company with its ticker."""
    fin = last_per_key(financials(spark, folder), ["company"], [F.col("year")])
    return fin.withColumn("ticker", F.expr(TICKER.format("company")))


LATEST_SQL = f"""{FIN_SQL}, lat AS (SELECT *, {TICKER_SQL.format('company')} AS ticker FROM (
 SELECT *, row_number() OVER (PARTITION BY company ORDER BY year DESC) AS rn FROM fin) WHERE rn = 1)"""
COUNT_SQL = ("SELECT ticker, CAST(" + " + ".join(
    f"CASE WHEN {metric_status_sql(m.name)} = 'computed' THEN 1 ELSE 0 END" for m in ratios.METRICS)
    + " AS BIGINT) AS computed, share_price, market_cap FROM lat")
PC_SQL = f"{PLAN_SQL}, {LATEST_SQL}, pc AS (SELECT request_id, unnest(companies) AS ticker, generate_subscripts(companies, 1) - 1 AS pos FROM pl), cnt AS ({COUNT_SQL})"


def engine(spark, folder):
    lat = latest(spark, folder)
    metrics = ratios.metric_summary(ratios.compute_all(lat, ["ticker"]), ["ticker"])
    health = peers.health_score(lat, ["ticker"]).select("ticker", F.col("overall").alias("health"))
    return P.run_engine(plans(spark, folder), metrics, health)


@query("exec_financial_engine", f"""WITH {PC_SQL} SELECT request_id, CAST(pos AS INTEGER) AS pos, ticker, computed,
 CASE WHEN computed IS NULL THEN 'no financial data' END AS error FROM pc LEFT JOIN cnt USING (ticker)""")
def exec_financial_engine(spark, folder):
    return engine(spark, folder).select("request_id", "pos", "ticker", "computed", "error")


def snapshots(spark, folder):
    return latest(spark, folder).select("ticker", F.col("share_price").alias("current_price"), "market_cap")


@query("gather_market", f"""WITH {PC_SQL} SELECT request_id, CAST(pos AS INTEGER) AS pos, ticker, round(share_price, 4) AS current_price,
 CASE WHEN computed IS NULL THEN 'no market data' END AS error FROM pc LEFT JOIN cnt USING (ticker)""")
def gather_market(spark, folder):
    return P.gather_market(plans(spark, folder), snapshots(spark, folder)).select(
        "request_id", "pos", "ticker", F.round("current_price", 4).alias("current_price"), "error")


NEWS_PER_COMPANY = 5


def company_news(spark, folder):
    """News of a company: the first line of each document and the text below it, filed under one of a hundred tickers."""
    return table(spark, folder, "documents").select(
        F.expr(TICKER.format("doc_id % 100")).alias("ticker"), F.col("doc_id").alias("pos"),
        F.element_at(F.split("text", "\n"), 1).alias("title"), F.expr(REST).alias("summary"))


NEWS_SQL = f"nw AS (SELECT {TICKER_SQL.format('doc_id % 100')} AS ticker, doc_id, string_split(text, chr(10))[1] AS title, {REST_SQL} AS summary FROM documents)"


@query("gather_news", f"""WITH {PC_SQL}, {NEWS_SQL}, nr AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY doc_id, title) AS news_pos FROM nw)
SELECT request_id, CAST(pos AS INTEGER) AS pos, ticker, CAST(NULL AS BIGINT) AS news_pos, CAST(NULL AS VARCHAR) AS digest FROM pc WHERE ticker IN (SELECT ticker FROM nw)
UNION ALL SELECT NULL, NULL, ticker, news_pos, md5(title || chr(10) || summary) FROM nr WHERE ticker IN (SELECT ticker FROM pc)""")
def gather_news(spark, folder):
    """All news of every planned company: which requests ask for it, and each of its news once."""
    news = company_news(spark, folder).select("ticker", "pos", "title", F.md5(F.concat("title", F.lit("\n"), "summary")).alias("digest"))
    return P.gather_all_news(plans(spark, folder), news).select("request_id", "pos", "ticker", "news_pos", "digest")


MULTI_SQL = retrieval_sql.found_in_documents_sql(retrieval_sql.embed_sql(f"""{GENQ_SQL}, mq AS (SELECT request_id, companies[1] AS first_company, unnest(qs) AS query,
 generate_subscripts(qs, 1) - 1 AS query_no FROM gq)""", "mq", "query", "me") + """, qs AS (SELECT request_id || '#' || CAST(query_no AS VARCHAR) AS query_id,
 'SRC' || CAST(CAST('0x' || left(md5(first_company), 4) AS INTEGER) % 20 AS VARCHAR) AS company, v, request_id, query_no FROM me)""", 5)


@query("multi_query_retrieve", f"""WITH {MULTI_SQL}, mf AS (SELECT f.*, qs.request_id, qs.query_no FROM fin_hits f JOIN qs USING (query_id)),
mo AS (SELECT *, row_number() OVER (PARTITION BY request_id, chunk_id ORDER BY query_no, position) AS nth FROM mf)
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY query_no, position) AS INTEGER) AS pos, chunk_id, score,
 CAST(query_no AS INTEGER) AS query_no FROM mo WHERE nth = 1""")
def multi_query_retrieve(spark, folder):
    """Each company of a plan stands for one of the twenty sources of the documents."""
    source = lambda c: F.concat(F.lit("SRC"), F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int") % 20)
    made = plans(spark, folder).withColumn("companies", F.transform("companies", source))
    return retrieval.multi_query_retrieve(made, document_chunks(spark, folder), V.embed_fn, texts=False).select(
        "request_id", "pos", "chunk_id", "score", "query_no")


LATEST_LONG_SQL = "ll AS (" + " UNION ALL ".join(f"SELECT ticker, '{m.name}' AS metric, {metric_value_sql(m.name)} AS value FROM lat" for m in ratios.METRICS) + ")"
PEERS_SQL = f"""{LATEST_LONG_SQL}, rp AS (SELECT request_id, metric, ticker, value, CAST(row_number() OVER (PARTITION BY request_id, metric
 ORDER BY CASE WHEN metric IN ('debt_to_equity', 'debt_to_assets', 'pe_ratio', 'ev_to_ebitda') THEN value ELSE -value END, pos) AS INTEGER) AS rank
 FROM pc JOIN ll USING (ticker) JOIN (SELECT request_id, len(companies) AS named FROM pl) USING (request_id) WHERE value IS NOT NULL AND named > 1)"""


def ranked_peers(spark, folder):
    return P.request_peers(plans(spark, folder), ratios.compute_all(latest(spark, folder), ["ticker"]))


@query("request_peers", f"WITH {PC_SQL}, {PEERS_SQL} SELECT request_id, metric, rank, ticker, value FROM rp")
def request_peers(spark, folder):
    return ranked_peers(spark, folder)


@query("execution_trace", f"""WITH {PC_SQL}, {PEERS_SQL}, {NEWS_SQL}, nr AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY doc_id, title) AS news_pos FROM nw),
got AS (SELECT request_id, 'financial_engine' AS tool, computed IS NULL AS failed FROM pc LEFT JOIN cnt USING (ticker)
 UNION ALL SELECT request_id, 'market_service', computed IS NULL FROM pc LEFT JOIN cnt USING (ticker)
 UNION ALL SELECT request_id, 'retriever', false FROM pl JOIN documents ON doc_id // 2 = CAST(regexp_extract(request_id, '^R(\\d+)', 1) AS BIGINT)
 UNION ALL SELECT request_id, 'news_service', false FROM pc JOIN nr USING (ticker) WHERE news_pos <= 5
 UNION ALL SELECT request_id, 'peer_comparison', false FROM rp),
n AS (SELECT request_id, tool, count(*) FILTER (NOT failed) AS items, count(*) FILTER (failed) AS errors FROM got GROUP BY ALL),
steps AS (SELECT request_id, companies, unnest(['financial_engine', 'market_service', 'retriever', 'news_service', 'peer_comparison']) AS tool, unnest([0, 1, 2, 3, 4]) AS step FROM pl)
SELECT s.request_id, CAST(step AS INTEGER) AS step, s.tool, CASE WHEN s.tool = 'retriever' AND len(companies) = 0 THEN 'skipped' WHEN s.tool = 'peer_comparison' AND len(companies) < 2 THEN 'skipped' ELSE 'success' END AS status,
 coalesce(items, 0) AS items, coalesce(errors, 0) AS errors FROM steps s LEFT JOIN n ON n.request_id = s.request_id AND n.tool = s.tool""")
def execution_trace(spark, folder):
    made = plans(spark, folder)
    return P.execution_trace(made, {
        "financial_engine": engine(spark, folder), "market_service": P.gather_market(made, snapshots(spark, folder)),
        "retriever": retrieved_for(spark, folder, made), "news_service": P.gather_news(made, company_news(spark, folder), NEWS_PER_COMPANY),
        "peer_comparison": ranked_peers(spark, folder)})


def retrieved_for(spark, folder, made):
    """What was retrieved for a request: the two documents numbered by its conversation."""
    found = table(spark, folder, "documents").selectExpr("doc_id div 2 AS conv", "cast(doc_id % 2 as int) AS pos", "text", "lang AS section", "(doc_id % 100) / 100D AS score")
    asked = made.select("request_id", F.regexp_extract("request_id", r"^R(\d+)", 1).cast("long").alias("conv"))
    return asked.join(found, "conv").drop("conv")


@query("assemble_evidence", f"""WITH {PC_SQL}, {PEERS_SQL}, {NEWS_SQL}, nr AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY doc_id, title) AS news_pos FROM nw),
nn AS (SELECT request_id, count(*) AS news, md5(string_agg(pos || ':' || news_pos || ':' || md5(title || summary), ',' ORDER BY pos, news_pos)) AS news_digest FROM pc JOIN nr USING (ticker) WHERE news_pos <= 5 GROUP BY 1),
ch AS (SELECT request_id, count(*) AS retrieved, md5(string_agg(doc_id % 2 || ':' || md5(text), ',' ORDER BY doc_id % 2)) AS chunk_digest
 FROM pl JOIN documents ON doc_id // 2 = CAST(regexp_extract(request_id, '^R(\\d+)', 1) AS BIGINT) GROUP BY 1),
pr AS (SELECT request_id, string_agg(metric || ':' || rank || ':' || ticker, ',' ORDER BY metric, rank) AS ranked FROM rp GROUP BY 1),
base AS (SELECT request_id, request_type, coalesce(companies[1], 'UNKNOWN') AS ticker FROM pl)
SELECT coalesce(pr.ranked, '') AS peer_comparison, b.request_id, b.request_type, b.ticker, coalesce(s.s_name, b.ticker) AS name, coalesce('N' || CAST(s.s_nationkey AS VARCHAR), 'Unknown') AS sector,
 c.computed, round(c.share_price, 4) AS current_price, coalesce(nn.news, 0) AS news, nn.news_digest,
 coalesce(ch.retrieved, 0) AS retrieved, ch.chunk_digest
FROM base b LEFT JOIN (SELECT *, {TICKER_SQL.format('s_suppkey')} AS tk FROM supplier) s ON s.tk = b.ticker
LEFT JOIN cnt c ON c.ticker = b.ticker LEFT JOIN nn ON nn.request_id = b.request_id LEFT JOIN ch ON ch.request_id = b.request_id LEFT JOIN pr ON pr.request_id = b.request_id""")
def assemble_evidence(spark, folder):
    made = plans(spark, folder)
    info = table(spark, folder, "supplier").select(
        F.expr(TICKER.format("s_suppkey")).alias("ticker"), F.col("s_name").alias("name"), F.concat(F.lit("N"), "s_nationkey").alias("sector"))
    out = P.assemble_evidence(made, info, engine(spark, folder), P.gather_market(made, snapshots(spark, folder)), retrieved_for(spark, folder, made),
                              P.gather_news(made, company_news(spark, folder), NEWS_PER_COMPANY), ranked_peers(spark, folder))
    ranked = F.array_join(F.transform("peer_comparison", lambda p: F.concat_ws(":", p["metric"], p["rank"], p["ticker"])), ",")
    return out.select(ranked.alias("peer_comparison"), "request_id", "request_type", "ticker", "name", "sector", "computed",
                      F.round("current_price", 4).alias("current_price"), "news",
                      F.md5(F.array_join(F.transform("news_items", lambda n: F.concat_ws(":", n["pos"], n["news_pos"], F.md5(F.concat(n["title"], n["summary"])))), ",")).alias("news_digest"),
                      "retrieved", F.md5(F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["pos"], F.md5(c["text"]))), ",")).alias("chunk_digest"))


# --- reports --------------------------------------------------------------------

def report_sections(spark, folder):
    keys = ", ".join(f"'{k}'" for k in E.SECTION_ORDER)
    return table(spark, folder, "documents").selectExpr(
        "doc_id div 7 AS report_id", f"element_at(array({keys}), cast(doc_id % 7 + 1 as int)) AS section_key",
        """concat('**Revenue** grew by ', doc_id % 50, '.5% in the year [', doc_id % 9, ']. *Margins* reached 1', doc_id % 3, '.25 percent. ',
          text, ' Figure 77', doc_id, ' was not reported. See note.') AS content""",
        "if(doc_id % 5 = 0, null, (doc_id % 10) / 10D) AS confidence")


SECTION_SQL = ("rs AS (SELECT doc_id // 7 AS report_id, [" + ", ".join(f"'{k}'" for k in E.SECTION_ORDER) + """][doc_id % 7 + 1] AS section_key, doc_id % 7 + 1 AS section_no,
 '**Revenue** grew by ' || CAST(doc_id % 50 AS VARCHAR) || '.5% in the year [' || CAST(doc_id % 9 AS VARCHAR) || ']. *Margins* reached 1' || CAST(doc_id % 3 AS VARCHAR)
 || '.25 percent. ' || text || ' Figure 77' || CAST(doc_id AS VARCHAR) || ' was not reported. See note.' AS content,
 CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 10) / 10::DOUBLE END AS confidence FROM documents)""")


def evidence_chunks(spark, folder):
    """Evidence of report r: the documents of report r + 1; those of report 0 come after them in report 1."""
    return table(spark, folder, "documents").selectExpr(
        "if(doc_id < 7, 1, doc_id div 7 - 1) AS report_id", "cast(if(doc_id < 7, doc_id + 7, doc_id % 7) as int) AS pos", "text", "lang AS section",
        "cast(doc_id % 4 as int) AS page_start", "cast(doc_id % 4 + doc_id % 2 as int) AS page_end",
        "(doc_id % 100) / 100D AS score", "source AS company", "concat('C', doc_id) AS chunk_id")


EVIDENCE_SQL = """ec AS (SELECT CASE WHEN doc_id < 7 THEN 1 ELSE doc_id // 7 - 1 END AS report_id, CASE WHEN doc_id < 7 THEN doc_id + 7 ELSE doc_id % 7 END AS pos, text, lang AS section, CAST(doc_id % 4 AS INTEGER) AS page_start,
 CAST(doc_id % 4 + doc_id % 2 AS INTEGER) AS page_end, (doc_id % 100) / 100::DOUBLE AS score, 'C' || doc_id AS chunk_id FROM documents)"""
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"
# A boundary is marked first, because the SQL side has no look-around.
SENTENCE_SQL = rf"""list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(content, '\*\*([^*]+)\*\*', '\1', 'g'),
 '\*([^*]+)\*', '\1', 'g'), '([.!?])\s+([A-Z])', '\1' || chr(10) || '\2', 'g'), '\n+'), lambda s: trim(s, {WS})), lambda s: s <> '')"""
CLAIM_SQL = f"""{SECTION_SQL}, se AS (SELECT report_id, section_key, section_no, {SENTENCE_SQL} AS ss FROM rs),
st AS (SELECT report_id, section_key AS section, CAST(section_no AS INTEGER) AS section_no, unnest(ss) AS text, CAST(generate_subscripts(ss, 1) - 1 AS INTEGER) AS pos FROM se),
cl AS (SELECT *, regexp_matches(text, '\\d') AS has_number, regexp_matches(text, '\\[\\d+\\]') AS has_citation FROM st
 WHERE length(text) >= 15 AND (regexp_matches(text, '\\d') OR {" OR ".join(f"contains(lower(text), '{k}')" for k in E.METRIC_KEYWORDS)}))"""


@query("split_sentences", f"WITH {SECTION_SQL}, s AS (SELECT report_id, section_key, {SENTENCE_SQL} AS ss FROM rs) SELECT report_id, section_key, CAST(len(ss) AS INTEGER) AS n, md5(array_to_string(ss, '|')) AS digest FROM s")
def split_sentences(spark, folder):
    s = report_sections(spark, folder).select("report_id", "section_key", E.split_sentences("content").alias("ss"))
    return s.select("report_id", "section_key", F.size("ss").alias("n"), F.md5(F.array_join("ss", "|")).alias("digest"))


def claims(spark, folder):
    return E.extract_claims(report_sections(spark, folder))


@query("extract_claims", f"WITH {CLAIM_SQL} SELECT report_id, section, section_no, pos, md5(text) AS digest, has_number, has_citation FROM cl")
def extract_claims(spark, folder):
    return claims(spark, folder).select("report_id", "section", "section_no", "pos", F.md5("text").alias("digest"), "has_number", "has_citation")


def words_sql(e):
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({e}), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 3))"


SUPPORT_SQL = f"""{CLAIM_SQL}, {EVIDENCE_SQL},
ct AS (SELECT *, regexp_extract_all(text, '\\d+\\.?\\d*') AS nums, {words_sql('text')} AS ws FROM cl),
et AS (SELECT report_id, pos AS epos, left(text, 200) AS snippet, regexp_extract_all(text, '\\d+\\.?\\d*') AS enums, {words_sql('text')} AS ews FROM ec),
sp AS (SELECT ct.report_id, ct.section_no, ct.pos, min_by(snippet, epos) AS chunk_snippet FROM ct JOIN et USING (report_id)
 WHERE list_has_any(nums, enums) OR len(list_intersect(ws, ews)) >= 3 GROUP BY ALL)"""


@query("claim_evidence_join", f"""WITH {SUPPORT_SQL} SELECT cl.report_id, cl.section_no, cl.pos, md5(chunk_snippet) AS digest
FROM cl LEFT JOIN sp USING (report_id, section_no, pos)""")
def claim_evidence_join(spark, folder):
    return E.claim_evidence_join(claims(spark, folder), evidence_chunks(spark, folder)).select(
        "report_id", "section_no", "pos", F.md5("chunk_snippet").alias("digest"))


def known_values(spark, folder):
    """Values a report may quote: per report, the ratios 10.25, 11.25, 12.25 and a price, by rule from its documents."""
    d = table(spark, folder, "documents").groupBy(F.expr("doc_id div 7").alias("report_id")).agg(F.sum("n_chars").alias("n"))
    return d.select("report_id", F.inline(F.array(
        F.struct(F.lit(0).alias("value_pos"), plain_number(F.expr("10.25D + n % 3")).alias("printed"),
                 F.concat(F.lit("Financial engine: roe = "), plain_number(F.expr("10.25D + n % 3")), F.lit("%")).alias("label")),
        F.struct(F.lit(1).alias("value_pos"), plain_number(F.expr("(n % 50) + 0.5D")).alias("printed"),
                 F.concat(F.lit("Market data: price = "), plain_number(F.expr("(n % 50) + 0.5D"))).alias("label")))))


VALUES_SQL = """kv AS (SELECT report_id, CAST(10.25::DOUBLE + n % 3 AS VARCHAR) AS p0, CAST(n % 50 + 0.5::DOUBLE AS VARCHAR) AS p1
 FROM (SELECT doc_id // 7 AS report_id, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY 1))"""
MATCH_SQL = "CASE WHEN contains(text, p0) THEN 'Financial engine: roe = ' || p0 || '%' WHEN contains(text, p1) THEN 'Market data: price = ' || p1 END"


@query("claim_metric_match", f"WITH {CLAIM_SQL}, {VALUES_SQL} SELECT report_id, section_no, pos, {MATCH_SQL} AS metric_match FROM cl LEFT JOIN kv USING (report_id)")
def claim_metric_match(spark, folder):
    return E.claim_metric_match(claims(spark, folder), known_values(spark, folder)).select("report_id", "section_no", "pos", "metric_match")


VERIFY_SQL = f"""{SUPPORT_SQL}, {VALUES_SQL}, vm AS (SELECT cl.*, coalesce(nullif(chunk_snippet, ''), {MATCH_SQL}) AS support
 FROM cl LEFT JOIN sp USING (report_id, section_no, pos) LEFT JOIN kv USING (report_id)),
vr AS (SELECT *, CASE WHEN support IS NOT NULL OR has_citation OR NOT has_number THEN 'verified' ELSE 'unverified' END AS verification,
 CASE WHEN support IS NOT NULL THEN support WHEN has_citation THEN 'Citation present (reference verified)' WHEN NOT has_number THEN 'Qualitative observation' ELSE '' END AS supporting_evidence FROM vm)"""


def verified(spark, folder):
    return E.verify_claims(claims(spark, folder), evidence_chunks(spark, folder), known_values(spark, folder))


@query("verify_claims", f"WITH {VERIFY_SQL} SELECT report_id, section_no, pos, verification, md5(supporting_evidence) AS digest FROM vr")
def verify_claims(spark, folder):
    return verified(spark, folder).select("report_id", "section_no", "pos", "verification", F.md5("supporting_evidence").alias("digest"))


@query("verification_summary", f"""WITH {VERIFY_SQL}, g AS (SELECT report_id, count(*) AS total_claims, count(*) FILTER (verification = 'verified') AS verified,
 count(*) FILTER (verification = 'unverified') AS unverified FROM vr GROUP BY 1)
SELECT report_id, coalesce(total_claims, 0) AS total_claims, coalesce(verified, 0) AS verified, coalesce(unverified, 0) AS unverified,
 CAST(0 AS BIGINT) AS revised, CAST(0 AS BIGINT) AS removed, coalesce(round(verified / total_claims, 2), 1) AS verification_rate
FROM (SELECT DISTINCT report_id FROM rs) LEFT JOIN g USING (report_id)""")
def verification_summary(spark, folder):
    return E.verification_summary(report_sections(spark, folder), verified(spark, folder))


@query("revise_report", f"""WITH {VERIFY_SQL}, bad AS (SELECT report_id, section AS section_key, count(*) AS n FROM vr WHERE verification = 'unverified' GROUP BY 1, 2),
notes AS (SELECT report_id, CAST(sum(n) AS BIGINT) AS c, count(*) AS s FROM bad GROUP BY 1)
SELECT report_id, section_key, length(content || CASE WHEN n IS NULL THEN '' ELSE chr(10) || chr(10) || '*Note: ' || n || ' statement(s) in this section could not be fully verified against the available evidence. Readers should cross-reference with primary sources.*' END) AS size,
 CASE WHEN n IS NULL THEN confidence ELSE round(greatest(0.1::DOUBLE, coalesce(confidence, 0.5::DOUBLE) - 0.1::DOUBLE * n), 2) END AS confidence,
 CASE WHEN c IS NULL THEN 'All claims verified — no revision needed.' ELSE c || ' claims revised across ' || s || ' sections.' END AS revision_notes
FROM rs LEFT JOIN bad USING (report_id, section_key) LEFT JOIN notes USING (report_id)""")
def revise_report(spark, folder):
    return E.revise_report(report_sections(spark, folder), verified(spark, folder)).select(
        "report_id", "section_key", F.length("content").cast("long").alias("size"), "confidence", "revision_notes")


BUCKET_SQL = (f"{EVIDENCE_SQL}, hay AS (SELECT *, lower(text || ' ' || section) AS h FROM ec), bk0 AS (SELECT *, list_filter(["
              + ", ".join("CASE WHEN " + " OR ".join(f"contains(h, '{w}')" for w in ws) + f" THEN '{n}' END" for n, ws in E.BUCKET_KEYWORDS.items())
              + "], lambda x: x IS NOT NULL) AS bs FROM hay), bk AS (SELECT report_id, pos, unnest(CASE WHEN len(bs) > 0 THEN bs ELSE ['other'] END) AS bucket FROM bk0)")


@query("evidence_buckets", f"WITH {BUCKET_SQL} SELECT report_id, CAST(pos AS INTEGER) AS pos, bucket FROM bk")
def evidence_buckets(spark, folder):
    return E.evidence_buckets(evidence_chunks(spark, folder)).select("report_id", "pos", "bucket")


FACTS_SQL = f"""{SECTION_SQL}, {BUCKET_SQL}, bc AS (SELECT report_id, bucket AS section_key, count(*) AS n FROM bk GROUP BY 1, 2),
fc AS (SELECT report_id, count(*) AS retrieved FROM ec GROUP BY 1),
sr AS (SELECT rs.report_id, rs.section_key, coalesce(nullif(n, 0), retrieved, 0) AS evidence_count,
 least(1, round(CASE WHEN rs.report_id % 4 <> 0 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN coalesce(nullif(n, 0), retrieved, 0) >= 3 THEN 0.35::DOUBLE WHEN coalesce(nullif(n, 0), retrieved, 0) >= 1 THEN 0.2::DOUBLE ELSE 0 END
 + CASE WHEN rs.report_id % 3 = 0 THEN 0.15::DOUBLE ELSE 0 END, 2)) AS confidence
 FROM rs LEFT JOIN bc USING (report_id, section_key) LEFT JOIN fc USING (report_id))"""


SOURCE_SQL = """coalesce(nullif(concat_ws(', ', nullif(section, ''), CASE WHEN page_start <> 0 THEN CASE WHEN page_end <> page_start AND page_end <> 0
 THEN 'Pages ' || page_start || '–' || page_end ELSE 'Page ' || page_start END END), ''), 'Unknown source')"""


def section_rows(spark, folder):
    chunks = evidence_chunks(spark, folder)
    counts = E.evidence_buckets(chunks).groupBy("report_id", F.col("bucket").alias("section_key")).agg(F.count(F.lit(1)).alias("n"))
    facts = (report_sections(spark, folder).select("report_id").distinct()
             .join(chunks.groupBy("report_id").agg(F.count(F.lit(1)).alias("retrieved")), "report_id", "left")
             .withColumns({"has_metrics": F.expr("report_id % 4 <> 0"), "has_news": F.expr("report_id % 3 = 0")}))
    return R.section_rows(report_sections(spark, folder).drop("confidence"), counts, facts)


@query("section_confidence", f"WITH {FACTS_SQL} SELECT report_id, section_key, evidence_count, confidence FROM sr")
def section_confidence(spark, folder):
    return section_rows(spark, folder).select("report_id", "section_key", "evidence_count", "confidence")


@query("report_rollup", f"""WITH {FACTS_SQL}, ci AS (SELECT report_id, md5(string_agg(pos || ':' || {SOURCE_SQL} || ':' || chunk_id, ',' ORDER BY pos)) AS citations FROM ec GROUP BY report_id) SELECT report_id, count(*) AS sections_generated, CAST(0 AS BIGINT) AS sections_failed,
 CAST(sum(evidence_count) AS BIGINT) AS evidence_total, round(CAST(sum(CAST(round(confidence * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100, 2) AS overall_confidence, any_value(citations) AS citations FROM sr LEFT JOIN ci USING (report_id) GROUP BY report_id""")
def report_rollup(spark, folder):
    out = R.report_rollup(section_rows(spark, folder), evidence_chunks(spark, folder))
    cited = F.transform("citations", lambda c: F.concat_ws(":", c["pos"], c["source"], c["chunk_id"]))
    return out.withColumn("citations", F.md5(F.array_join(cited, ",")))


@query("format_evidence", f"""WITH {EVIDENCE_SQL}, t AS (SELECT report_id, pos, row_number() OVER (PARTITION BY report_id ORDER BY pos) AS i,
 coalesce(nullif(concat_ws(', ', nullif(section, ''), CASE WHEN page_start <> 0 THEN CASE WHEN page_end <> page_start AND page_end <> 0 THEN 'Pages ' || page_start || '–' || page_end ELSE 'Page ' || page_start END END), ''), 'Unknown source') AS src,
 score, trim(text, {WS}) AS body FROM ec)
SELECT report_id, md5(string_agg('  [' || i || '] (' || src || ', relevance: ' || printf('%.2f', score) || ')' || chr(10) || '      ' || body || chr(10), chr(10) ORDER BY pos)) AS digest FROM t GROUP BY report_id""")
def format_evidence(spark, folder):
    return E.format_evidence(evidence_chunks(spark, folder), "report_id").select("report_id", F.md5("text").alias("digest"))


@query("format_news", f"""WITH {NEWS_SQL}, t AS (SELECT ticker, doc_id, row_number() OVER (PARTITION BY ticker ORDER BY doc_id) AS i, title, summary FROM nw)
SELECT ticker, md5(string_agg('  - ' || title || ' (day ' || doc_id || ')' || CASE WHEN summary <> '' THEN chr(10) || '    ' || summary ELSE '' END, chr(10) ORDER BY i)) AS digest FROM t GROUP BY ticker""")
def format_news(spark, folder):
    n = company_news(spark, folder).withColumn("date", F.concat(F.lit("day "), "pos"))
    return E.format_news(n, "ticker").select("ticker", F.md5("text").alias("digest"))


TWELVE_SQL = (f"{SECTION_SQL}, lay(id, title, key, txt) AS (VALUES " + ", ".join(
    f"({i}, '{t}', {repr(k) if k else 'NULL'}, {repr(x) if x else 'NULL'})" for i, t, k, x, _ in R.LAYOUT)
    + "), tw AS (SELECT r.report_id, CAST(id AS INTEGER) AS id, title, coalesce(txt, content, '') AS content, CASE WHEN key IS NOT NULL THEN coalesce(confidence, 0) END AS confidence "
    "FROM (SELECT DISTINCT report_id FROM rs) r CROSS JOIN lay LEFT JOIN rs ON rs.report_id = r.report_id AND rs.section_key = key)")


@query("build_12_sections", f"WITH {TWELVE_SQL} SELECT report_id, id, title, md5(content) AS digest, confidence FROM tw")
def build_12_sections(spark, folder):
    return R.build_12_sections(report_sections(spark, folder)).select("report_id", "id", "title", F.md5("content").alias("digest"), "confidence")


def report_heads(spark, folder):
    return report_sections(spark, folder).select("report_id").distinct().select(
        "report_id", F.concat(F.lit("Company "), "report_id").alias("company"), F.expr(TICKER.format("report_id")).alias("ticker"),
        F.concat(F.lit("2024-01-01T00:00:"), F.format_string("%02d", F.expr("report_id % 60"))).alias("generated_at"))


@query("report_markdown", f"""WITH {TWELVE_SQL}, {EVIDENCE_SQL}, ci AS (SELECT report_id, string_agg((pos + 1) || '. **' || section || '**: ' || left(text, 150) || chr(10), '' ORDER BY pos) || chr(10) AS src FROM ec GROUP BY 1),
bd AS (SELECT report_id, string_agg('## ' || title || chr(10) || chr(10) || CASE WHEN content <> '' THEN content || chr(10) || chr(10) ELSE '' END || CASE WHEN title = 'Sources' THEN coalesce(src, chr(10)) ELSE '' END, '' ORDER BY id) AS b
 FROM tw LEFT JOIN ci USING (report_id) GROUP BY report_id)
SELECT report_id, md5('# Equity Research Report: Company ' || report_id || ' (' || {TICKER_SQL.format('report_id')} || ')' || chr(10) || chr(10) || '**Generated At:** 2024-01-01T00:00:' || printf('%02d', report_id % 60) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || b) AS digest FROM bd""")
def report_markdown(spark, folder):
    cites = evidence_chunks(spark, folder).select("report_id", (F.col("pos") + 1).alias("ref"), F.col("section").alias("source"),
                                                  F.substring("text", 1, 150).alias("text_preview"))
    rows = R.build_12_sections(report_sections(spark, folder))
    return R.report_markdown(rows, report_heads(spark, folder), cites).select("report_id", F.md5("markdown").alias("digest"))


@query("report_json", f"""WITH {TWELVE_SQL} SELECT report_id, count(*) AS sections, 'Company ' || report_id AS company,
 CAST(sum(length(content)) AS BIGINT) AS characters FROM tw GROUP BY report_id""")
def report_json(spark, folder):
    made = R.report_json(R.build_12_sections(report_sections(spark, folder)), report_heads(spark, folder))
    back = F.from_json("report_json", "struct<metadata:struct<company:string>,sections:array<struct<id:int,content:string>>>")
    return made.select("report_id", back.alias("r")).select(
        "report_id", F.size("r.sections").cast("long").alias("sections"), "r.metadata.company",
        F.aggregate("r.sections", F.lit(0).cast("long"), lambda a, s: a + F.length(s["content"])).alias("characters"))


JSON_SQL = """js AS (SELECT report_id, '{"metadata":{"company":"Company ' || report_id || '","ticker":"' || TICKER || '","generated_at":"2024-01-01T00:00:' || printf('%02d', report_id % 60) || '"},"sections":['
 || string_agg('{"id":' || id || ',"title":' || to_json(title) || ',"content":' || to_json(content) || CASE WHEN confidence IS NOT NULL THEN ',"confidence":' || confidence ELSE '' END || '}', ',' ORDER BY id) || ']}' AS j
 FROM tw GROUP BY report_id)""".replace("TICKER", TICKER_SQL.format("report_id"))


@query("report_files", f"WITH {TWELVE_SQL}, {JSON_SQL} SELECT CAST(report_id AS VARCHAR) AS report_id, j AS report_json, length(j) AS characters FROM js")
def report_files(spark, folder):
    """The JSON of every report as a file of its own, read back as text; the files are written twice, the second time in place of the first."""
    # Written once, so that the second round of files does not make the reports again.
    made = materialize(R.report_json(R.build_12_sections(report_sections(spark, folder)), report_heads(spark, folder)), "report-rows")
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    write_report_files(made.withColumn("report_json", F.upper("report_json")), path, "report_json")
    write_report_files(made, path, "report_json", mode="overwrite")
    release(made)
    return read_report_files(spark, path, "report_json").withColumn("characters", F.length("report_json").cast("long"))


# --- versions -------------------------------------------------------------------

def _stored(spark, folder):
    """Reports saved before a date: one per order of a user and ticker, numbered in order."""
    o = table(spark, folder, "orders").where("o_orderdate < '2000-01-01'")
    return o.selectExpr("o_custkey AS user", "upper(o_orderpriority) AS ticker", "o_orderkey AS report_id", "o_orderdate AS created_at")


def _incoming(spark, folder):
    o = table(spark, folder, "orders").where("o_orderdate >= '2000-01-01'")
    return o.selectExpr("o_custkey AS user", "upper(o_orderpriority) AS ticker", "o_orderkey AS report_id", "o_orderdate AS created_at")


def _versions(spark, folder):
    stored = _stored(spark, folder)
    order = [F.col("created_at"), F.col("report_id")]
    old = R.next_versions(stored.limit(0), stored, order)
    return old.unionByName(R.next_versions(stored, _incoming(spark, folder), order))


VERSION_SQL = """ve AS (SELECT o_custkey AS user, upper(o_orderpriority) AS ticker, o_orderkey AS report_id,
 row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS version FROM orders)"""


@query("next_version", f"WITH {VERSION_SQL} SELECT user, ticker, report_id, version FROM ve")
def next_version(spark, folder):
    return _versions(spark, folder).select("user", "ticker", "report_id", "version")


@query("latest_report", f"WITH {VERSION_SQL} SELECT user, ticker, max_by(report_id, version) AS report_id, max(version) AS version FROM ve GROUP BY ALL")
def latest_report(spark, folder):
    return R.latest_report(_versions(spark, folder)).select("user", "ticker", "report_id", "version")


@query("report_versions", f"WITH {VERSION_SQL} SELECT version, report_id FROM ve WHERE user = 7 AND ticker = '2-HIGH'")
def report_versions(spark, folder):
    return R.report_versions(_versions(spark, folder), 7, "2-high").select("version", "report_id")
