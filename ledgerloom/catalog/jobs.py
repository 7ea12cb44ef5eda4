"""Queries over whole jobs: ingestion, answering, reports and the two streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.catalog import research, retrieval
from ledgerloom.catalog.cleaning import MERGE_SQL
from ledgerloom.catalog.filings import HTML_SQL
from ledgerloom.catalog.pages import PAGES_SQL
from ledgerloom.catalog.registry import query
from ledgerloom.operators import context as X
from ledgerloom.operators import embedding as E
from ledgerloom.plans import answering, ingestion, journal
from ledgerloom.plans import research as reporting
from ledgerloom.session import materialize, shared_dir
from ledgerloom.streaming import jobs, ttl
from ledgerloom.tables import table


def html_files(pages):
    return pages.selectExpr("concat('landing/p', page_id, '.html') AS path", "encode(html, 'utf-8') AS content")


def register(pages):
    """Registry rows of the pages: some embedded before, some without a file."""
    return pages.selectExpr(
        "concat('P', page_id) AS document_id", "concat('T', page_id % 40) AS ticker", "cast(2020 + page_id % 5 as int) AS year", "'annual_report' AS doc_type",
        "case page_id % 10 when 1 then '' when 2 then concat('landing/none', page_id) else concat('landing/p', page_id, '.html') end AS file_path",
        "if(page_id % 10 = 0, 'embedded', 'downloaded') AS processing_status")


def empty_cache(spark, folder):
    return retrieval.cache_rows(spark, folder, "false")


# Lines of a file fill pages, pages are cleaned and cut into chunks, and a document is embedded if it has chunks and all have
# a vector: words whose marks do not cancel each other out.
_STRIP = "trim({}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160))"
_FILL_TYPE = "STRUCT(done VARCHAR[], held VARCHAR[], size BIGINT)"
FILE_PAGES_SQL = f"""{HTML_SQL}, fp AS (SELECT page_id, list_reduce(ls, lambda a, l: CASE WHEN a.size + length(l) + 1 >= 4000
  THEN CAST({{'done': list_append(a.done, {_STRIP.format("array_to_string(list_append(a.held, l), chr(10))")}), 'held': [], 'size': 0}} AS {_FILL_TYPE})
  ELSE CAST({{'done': a.done, 'held': list_append(a.held, l), 'size': a.size + length(l) + 1}} AS {_FILL_TYPE}) END,
 CAST({{'done': [], 'held': [], 'size': 0}} AS {_FILL_TYPE})) AS f FROM hl WHERE page_id % 10 NOT IN (0, 1, 2)),
fq AS (SELECT page_id, list_concat(f.done, list_filter([{_STRIP.format("array_to_string(f.held, chr(10))")}], lambda t: t <> '')) AS ts FROM fp),
pg AS (SELECT 'P' || page_id AS document_id, CAST(unnest(generate_series(1, len(ts))) AS INTEGER) AS page, unnest(ts) AS text FROM fq)"""
LANDED_SQL = f"""{MERGE_SQL.replace(PAGES_SQL, FILE_PAGES_SQL)},
fm AS (SELECT document_id, list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: CAST('0x' || left(md5(w), 2) AS INTEGER) % 128) AS marks FROM fn),
good AS (SELECT document_id FROM fm GROUP BY document_id HAVING bool_and(list_sort(list_filter(marks, lambda m: m < 64))
  <> list_sort(list_transform(list_filter(marks, lambda m: m >= 64), lambda m: m - 64)))),
landed AS (SELECT page_id, 'P' || page_id AS document_id, CASE WHEN page_id % 10 = 0 THEN 'skipped' WHEN good.document_id IS NOT NULL THEN 'embedded' ELSE 'failed' END AS outcome
 FROM pages LEFT JOIN good ON good.document_id = 'P' || page_id)"""


@query("embed_documents_job", f"WITH {LANDED_SQL} SELECT document_id, outcome FROM landed")
def embed_documents_job(spark, folder):
    pages = table(spark, folder, "pages")
    done = ingestion.embed_documents_job(register(pages), html_files(pages), empty_cache(spark, folder))
    return done.outcomes.select("document_id", "outcome")


@query("ingest_journal", f"""WITH {LANDED_SQL} SELECT document_id, outcome,
 CASE WHEN page_id % 10 IN (0, 1, 2) THEN '' WHEN outcome = 'failed' THEN 'extract,chunk' ELSE 'extract,chunk,embed,upsert' END AS stages,
 CASE WHEN page_id % 10 IN (0, 1, 2) THEN 0 WHEN page_id % 2 = 0 THEN 1 ELSE 2 END AS call, outcome = 'embedded' AS stored FROM landed""")
def ingest_journal(spark, folder):
    """Files land in two calls, the second with all of them: what each document finished, and in which call."""
    out, pages = _out(spark), table(spark, folder, "pages")
    cache, vectors, stages = journal.cache_table(spark, f"{out}/cache", 8), journal.vector_table(spark, f"{out}/vectors", 8), journal.StageJournal(spark, f"{out}/stages")
    journal.resume_documents_job(register(pages.where("page_id % 2 = 0")), html_files(pages.where("page_id % 2 = 0")), cache, vectors, stages)
    early = materialize(stages.entries().select("run").distinct().withColumn("call", F.lit(1)), "calls")
    outcomes = journal.resume_documents_job(register(pages), html_files(pages), cache, vectors, stages)
    finished = stages.entries().join(early, "run", "left").groupBy("document_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("finished_at", "stage"))), lambda e: e["stage"]), ",").alias("stages"), F.min(F.coalesce("call", F.lit(2))).alias("call"))
    stored = vectors.read().select("document_id", F.lit(True).alias("stored")).distinct()
    return (outcomes.join(finished, "document_id", "left").join(stored, "document_id", "left")
            .select("document_id", "outcome", F.coalesce("stages", F.lit("")).alias("stages"), F.coalesce("call", F.lit(0)).alias("call"), F.coalesce("stored", F.lit(False)).alias("stored")))


@query("embed_stats")
def embed_stats(spark, folder):
    pages = table(spark, folder, "pages")
    return ingestion.embed_documents_job(register(pages), html_files(pages), empty_cache(spark, folder)).stats()


def _answered(spark, folder):
    q = retrieval.questions(spark, folder).select(F.col("question_id").alias("query_id"), "question", F.expr("concat('src', conv_id % 20)").alias("company"))
    return answering.answer_questions(q, retrieval.document_chunks(spark, folder))


ANSWER_SQL = retrieval.confidence_sql(retrieval.context_sql(retrieval.found_in_documents_sql(
    retrieval.ASKED_SQL + ", qs AS (SELECT query_id, company, v FROM qe)", 10), 6000))


@query("answer_record", f"""WITH {ANSWER_SQL}, fh AS (SELECT query_id, count(*) AS chunks_retrieved FROM fin_hits GROUP BY query_id),
ar AS (SELECT qe.query_id, question_type, query_used, CASE WHEN trim(coalesce(context_text, '')) = '' THEN 'insufficient' ELSE 'answer' END AS route,
 coalesce(confidence, 0) AS confidence, {retrieval.TIER_SQL} AS tier,
 coalesce(chunks_retrieved, 0) AS chunks_retrieved, coalesce(cx.chunks_used, 0) AS chunks_used, coalesce(confidence >= 0.4, false) AS evidence_sufficient
 FROM qe LEFT JOIN cx ON cx.query_id = qe.query_id LEFT JOIN cf ON cf.query_id = qe.query_id LEFT JOIN fh ON fh.query_id = qe.query_id)
SELECT *, CASE WHEN route = 'insufficient' THEN 'The available documents do not contain sufficient information to answer this question. Please ensure relevant documents have been indexed for this company.' END AS answer FROM ar""")
def answer_record(spark, folder):
    return _answered(spark, folder).records().select(
        "query_id", "question_type", "query_used", "route", "answer", "confidence", "tier", "chunks_retrieved", "chunks_used", "evidence_sufficient")


@query("prompt_text", f"""WITH {ANSWER_SQL}, pt AS (SELECT qe.query_id, CASE question_type WHEN 'summarization' THEN 'summarize.txt' WHEN 'comparative' THEN 'compare.txt' ELSE 'rag_answer.txt' END AS template_used,
 CASE question_type WHEN 'summarization' THEN 'Summarise the numbered context for the question and cite the numbers used.'
  WHEN 'comparative' THEN 'Compare what the question names, from the numbered context only, and cite the numbers used.'
  ELSE 'Answer the question from the numbered context only and cite the numbers used.' END
 || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || coalesce(context_text, '') || chr(10) AS prompt
 FROM qe LEFT JOIN cx ON cx.query_id = qe.query_id) SELECT query_id, template_used, CAST(length(prompt) AS INTEGER) AS size, md5(prompt) AS digest FROM pt""")
def prompt_text(spark, folder):
    return _answered(spark, folder).prompts(X.templates(spark)).select(
        "query_id", "template_used", F.length("prompt").alias("size"), F.md5("prompt").alias("digest"))


@query("research_report", f"""WITH {research.FACTS_SQL} SELECT report_id, count(*) AS sections_generated,
 round(CAST(sum(CAST(round(confidence * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100, 2) AS overall_confidence, CAST(12 AS BIGINT) AS layout_rows FROM sr GROUP BY report_id""")
def research_report(spark, folder):
    facts = research.report_sections(spark, folder).select("report_id").distinct().withColumns(
        {"has_metrics": F.expr("report_id % 4 <> 0"), "has_news": F.expr("report_id % 3 = 0")})
    done = reporting.research_reports(research.report_sections(spark, folder), research.evidence_chunks(spark, folder), research.known_values(spark, folder), facts)
    rows = done.layout.groupBy("report_id").agg(F.count(F.lit(1)).alias("layout_rows"))
    return done.rollup.select("report_id", "sections_generated", "overall_confidence").join(rows, "report_id")


# --- streams ----------------------------------------------------------------------

def stream_of(spark, folder, name):
    """A table as a stream of its files, be it one file or a folder of parts: a pattern of one name matches either."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{{{name}.parquet}}")


def _out(spark):
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("ingest_stream")
def ingest_stream(spark, folder):
    """Pages as a stream of landed files through the ingestion job; the progress table."""
    out = _out(spark)
    files = html_files(stream_of(spark, folder, "pages"))
    def known(batch):
        return batch.selectExpr("regexp_extract(path, '(p[0-9]+)', 1) AS document_id", "'T' AS ticker", "2024 AS year",
                                "'annual_report' AS doc_type", "path AS file_path", "'downloaded' AS processing_status")

    jobs.ingest_stream(files, out, empty_cache(spark, folder), known).awaitTermination()
    return spark.read.parquet(f"{out}/progress").select("document_id", "stage", "n")


@query("quote_cache_stream", """SELECT 'U' || user_id AS ticker, arg_max(value, (ts, event_id, value)) AS value, max(ts) AS as_of, count(*) AS updates, max(ts) > TIMESTAMP '2024-01-30 12:00:00' AS fresh
 FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def quote_cache_stream(spark, folder):
    """Ticks as a stream; an error event is a failed fetch, which keeps the value before it; of events of one time the last one counts."""
    out = _out(spark)
    ticks = stream_of(spark, folder, "events").selectExpr("concat('U', user_id) AS ticker", "ts", "event_id", "if(event_type = 'error', null, value) AS price")
    jobs.quote_cache_stream(ticks, out, order=["event_id"]).awaitTermination()
    return jobs.freshness(jobs.read_quotes(spark, out), "2024-01-31 12:00:00", 86400)


# An hour of the events is a second here, so that requests of one ticker come as often as pages ask for it.
def _ttl_sql(seconds):
    return f"""WITH RECURSIVE e AS (SELECT 'U' || user_id AS ticker, event_id, epoch_us(ts) // 3600 AS us, CASE WHEN event_type <> 'error' THEN value END AS price,
 row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 3600, event_id) AS n FROM events),
ok AS (SELECT ticker, us, min(n) AS n FROM e WHERE price IS NOT NULL GROUP BY ticker, us),
later AS (SELECT a.ticker, a.n, min(b.n) AS next_n FROM ok a JOIN ok b ON a.ticker = b.ticker AND a.us + {seconds} * 1000000 <= b.us GROUP BY ALL),
f AS (SELECT ticker, min(n) AS n FROM ok GROUP BY ticker UNION ALL SELECT f.ticker, later.next_n FROM f JOIN later ON later.ticker = f.ticker AND later.n = f.n),
known AS (SELECT f.ticker, f.n, e.us, e.price FROM f JOIN e ON e.ticker = f.ticker AND e.n = f.n)
SELECT e.ticker, e.event_id, CASE WHEN k.n IS NULL THEN 'failed' WHEN k.n = e.n THEN 'fetch' WHEN e.us < k.us + {seconds} * 1000000 THEN 'served' ELSE 'stale' END AS answer,
 k.price AS value, make_timestamp(k.us) AS as_of FROM e ASOF LEFT JOIN known k ON k.ticker = e.ticker AND e.n >= k.n"""


def _ttl(spark, folder, seconds):
    out = _out(spark)
    requests = stream_of(spark, folder, "events").selectExpr("concat('U', user_id) AS ticker", "event_id", "timestamp_micros(unix_micros(cast(ts as timestamp)) div 3600) AS ts", "if(event_type = 'error', null, value) AS value")
    ttl.ttl_stream(requests, out, "ticker", "ts", "event_id", "value", seconds).awaitTermination()
    return spark.read.parquet(f"{out}/answers").select("ticker", "event_id", "answer", "value", "as_of")


@query("quote_ttl_stream", _ttl_sql(30))
def quote_ttl_stream(spark, folder):
    """Every event asks for its ticker's quote; an error event is a request whose fetch fails."""
    return _ttl(spark, folder, jobs.QUOTE_TTL_SECONDS)


@query("news_ttl_stream", _ttl_sql(240))
def news_ttl_stream(spark, folder):
    """The same requests with the time to live of news."""
    return _ttl(spark, folder, jobs.NEWS_TTL_SECONDS)
