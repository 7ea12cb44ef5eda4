"""Queries over vectors, hits, contexts and questions.

The given vectors are chunks: the label is the section, the id decides company, year
and type, and the document with the same id gives the text.  The questions of a
search are the centre of each section, asked for each company it occurs in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.catalog.registry import query
from ledgerloom.functions import vectors as V
from ledgerloom.functions.numeric import safe_or
from ledgerloom.operators import context as X
from ledgerloom.operators import embedding as E
from ledgerloom.operators import retrieval as R
from ledgerloom.operators.chunking import estimate_tokens
from ledgerloom.session import materialize, shared_dir
from ledgerloom.sources.snapshots import SnapshotTable
from ledgerloom.tables import table

TOP_K = 5
REQUESTED = 10


def vectors(spark, folder):
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    v = table(spark, folder, "embeddings").join(texts, "vec_id", "left")
    return v.select(
        F.format_string("C%06d", "vec_id").alias("chunk_id"), F.expr("concat('D', vec_id div 10)").alias("document_id"),
        F.expr("concat('CO', vec_id % 5)").alias("company"),
        F.expr("cast(if(vec_id % 11 = 0, null, 2020 + vec_id % 4) as int)").alias("year"),
        F.expr("case vec_id % 3 when 0 then 'annual_report' when 1 then 'quarterly_report' else 'announcement' end").alias("doc_type"),
        F.expr("if(label = 9, null, concat('S', label))").alias("section"), F.lit(None).cast("string").alias("subsection"),
        F.expr("cast(if(vec_id % 13 = 0, null, vec_id % 10 + 1) as int)").alias("page_start"),
        F.expr("cast(if(vec_id % 13 = 0, null, vec_id % 10 + 1 + vec_id % 2) as int)").alias("page_end"),
        F.coalesce("text", F.lit("")).alias("text"), estimate_tokens(F.coalesce("text", F.lit(""))).alias("token_count"),
        F.expr("vec_id % 4 = 0").alias("has_heading"), F.expr("vec_id % 6 = 0").alias("contains_table"),
        F.expr("(vec_id % 10) / 10D").alias("quality_score"), "embedding", "vec_id", "label")


def centres(spark, folder):
    """Sum of the vectors of each label in whole millionths; cosine ignores the length."""
    parts = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "e"))
    sums = parts.groupBy("label", "i").agg(
        F.sum(F.round(F.col("e").cast("double") * 1000000).cast("long")).alias("s"))
    return (sums.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("v"))
            .select("label", F.transform("v", lambda x: x["s"].cast("double")).alias("query_vector")))


def section_queries(spark, folder):
    """``query_id, company, query_vector``: every section centre for every company having it."""
    pairs = vectors(spark, folder).select("label", "company").distinct()
    return pairs.join(centres(spark, folder), "label").select(
        F.concat_ws("/", F.col("label").cast("string"), "company").alias("query_id"),
        F.concat(F.lit(" "), F.lower("company")).alias("company"), F.lit("None").alias("doc_type"), "query_vector")


VEC_SQL = """vec AS (SELECT printf('C%06d', vec_id) AS chunk_id, 'D' || CAST(vec_id // 10 AS VARCHAR) AS document_id,
 'CO' || CAST(vec_id % 5 AS VARCHAR) AS company, CAST(CASE WHEN vec_id % 11 <> 0 THEN 2020 + vec_id % 4 END AS INTEGER) AS year,
 CASE vec_id % 3 WHEN 0 THEN 'annual_report' WHEN 1 THEN 'quarterly_report' ELSE 'announcement' END AS doc_type,
 CASE WHEN label <> 9 THEN 'S' || CAST(label AS VARCHAR) END AS section,
 CAST(CASE WHEN vec_id % 13 <> 0 THEN vec_id % 10 + 1 END AS INTEGER) AS page_start,
 CAST(CASE WHEN vec_id % 13 <> 0 THEN vec_id % 10 + 1 + vec_id % 2 END AS INTEGER) AS page_end,
 coalesce(text, '') AS text, CAST(greatest(1, length(coalesce(text, '')) // 4) AS INTEGER) AS token_count,
 vec_id % 4 = 0 AS has_heading, vec_id % 6 = 0 AS contains_table, (vec_id % 10) / 10::DOUBLE AS quality_score,
 embedding, vec_id, label FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"""
CENTRE_SQL = """centre AS (SELECT label, list(s ORDER BY i) AS q FROM (SELECT label, i,
 CAST(sum(CAST(round(CAST(e AS DOUBLE) * 1000000) AS BIGINT)) AS DOUBLE) AS s
 FROM (SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""


def search_sql(k: int, where: str = "true") -> str:
    return f"""{VEC_SQL}, {CENTRE_SQL},
qs AS (SELECT DISTINCT vec.label, company, CAST(vec.label AS VARCHAR) || '/' || company AS query_id FROM vec),
sc AS (SELECT query_id, vec.*, list_dot_product(q, CAST(embedding AS DOUBLE[]))
  / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS raw
  FROM qs JOIN centre USING (label) JOIN vec ON vec.company = qs.company WHERE {where}),
hit AS (SELECT *, round(raw, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank
  FROM sc) WHERE rank <= {k})"""


BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"


def keep_sql(top_k: int) -> str:
    return f"""short AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM hit
 WHERE length(trim(text, {BLANKS})) >= 40),
rr AS (SELECT *, round(least(1::DOUBLE, score + CASE WHEN has_heading THEN 0.02::DOUBLE ELSE 0 END
 + CASE WHEN quality_score > 0.8 THEN 0.01::DOUBLE ELSE 0 END - CASE WHEN contains_table THEN 0.01::DOUBLE ELSE 0 END
 + CASE WHEN section <> '' THEN 0.02::DOUBLE ELSE 0 END), 4) AS adj FROM short),
ro AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY adj DESC, rank) AS rank FROM rr),
dd AS (SELECT * FROM ro a WHERE NOT EXISTS (SELECT 1 FROM ro b WHERE b.query_id = a.query_id AND b.rank < a.rank
  AND left(b.text, 200) = left(a.text, 200))),
tk AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM dd),
tt AS (SELECT *, min(rank) OVER (PARTITION BY query_id, document_id) AS doc_first FROM tk WHERE rank <= {top_k}),
fin_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_first, coalesce(page_start, 0), rank) AS position FROM tt)"""


KEEP_SQL = keep_sql(TOP_K)
RETRIEVE_SQL = f"{search_sql(40, 'token_count >= 20')}, {KEEP_SQL}"


@query("vector_search", f"WITH {search_sql(TOP_K)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM hit")
def vector_search(spark, folder):
    return R.vector_search(section_queries(spark, folder), vectors(spark, folder), TOP_K).select(
        "query_id", "rank", "chunk_id", "score")


@query("metadata_filter", f"""WITH {VEC_SQL} SELECT chunk_id, company, year, doc_type, token_count FROM vec
 WHERE company = 'CO3' AND doc_type = 'annual_report' AND token_count >= 20""")
def metadata_filter(spark, folder):
    return R.metadata_filter(vectors(spark, folder), company=" co3 ", year=0, doc_type="Annual_Report",
                             section="None", document_id=" string", min_tokens=20).select(
        "chunk_id", "company", "year", "doc_type", "token_count")


@query("min_text_filter", f"WITH {VEC_SQL} SELECT chunk_id, length(text) AS size FROM vec WHERE length(trim(text, {BLANKS})) >= 40")
def min_text_filter(spark, folder):
    return R.min_text_filter(vectors(spark, folder)).select("chunk_id", F.length("text").cast("long").alias("size"))


@query("score_threshold", f"WITH {search_sql(40)} SELECT query_id, chunk_id, score FROM hit WHERE score >= 0.3")
def score_threshold(spark, folder):
    hits = R.vector_search(section_queries(spark, folder), vectors(spark, folder), 40)
    return R.score_threshold(hits, 0.3).select("query_id", "chunk_id", "score")


@query("relevance_tier", f"""WITH {search_sql(40)} SELECT CASE WHEN score >= 0.85 THEN 'excellent' WHEN score >= 0.75 THEN 'good'
 WHEN score >= 0.6 THEN 'fair' ELSE 'low' END AS tier, count(*) AS n FROM hit GROUP BY 1""")
def relevance_tier(spark, folder):
    hits = R.vector_search(section_queries(spark, folder), vectors(spark, folder), 40)
    return hits.groupBy(R.relevance_tier("score").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def _deep(spark, folder):
    hits = R.vector_search(section_queries(spark, folder), vectors(spark, folder), 40, min_tokens=20)
    return R.renumber(R.min_text_filter(hits))


@query("rerank", f"WITH {RETRIEVE_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, adj AS rerank_score FROM ro")
def rerank(spark, folder):
    return R.rerank(_deep(spark, folder)).select("query_id", "rank", "chunk_id", "rerank_score")


@query("deduplicate_hits", f"WITH {RETRIEVE_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM dd")
def deduplicate_hits(spark, folder):
    return R.deduplicate_hits(R.rerank(_deep(spark, folder))).select("query_id", "rank", "chunk_id")


@query("assemble_context", f"WITH {RETRIEVE_SQL} SELECT query_id, CAST(position AS INTEGER) AS position, document_id, page_start, chunk_id FROM fin_hits")
def assemble_context(spark, folder):
    hits = R.deduplicate_hits(R.rerank(_deep(spark, folder)))
    top = R.renumber(hits).where(F.col("rank") <= TOP_K)
    return R.assemble_context(top).select("query_id", "position", "document_id", "page_start", "chunk_id")


def _retrieved(spark, folder):
    return R.retrieve(section_queries(spark, folder), vectors(spark, folder), TOP_K)


@query("retrieve", f"""WITH {RETRIEVE_SQL} SELECT query_id, CAST(position AS INTEGER) AS position, chunk_id, score,
 CASE WHEN score >= 0.85 THEN 'excellent' WHEN score >= 0.75 THEN 'good' WHEN score >= 0.6 THEN 'fair' ELSE 'low' END AS relevance FROM fin_hits""")
def retrieve(spark, folder):
    return _retrieved(spark, folder).select("query_id", "position", "chunk_id", "score", "relevance")


SOURCE_SQL = """concat_ws(', ', nullif(company, ''), nullif(doc_type, ''), CAST(nullif(year, 0) AS VARCHAR), nullif(section, ''),
 CASE WHEN page_start <> 0 THEN CASE WHEN page_end <> page_start THEN 'Pages ' || page_start || '–' || page_end ELSE 'Page ' || page_start END END)"""


@query("source_string", f"WITH {VEC_SQL} SELECT chunk_id, {SOURCE_SQL} AS source FROM vec")
def source_string(spark, folder):
    return vectors(spark, folder).select("chunk_id", X.source_string().alias("source"))


BUDGET = 900


def context_sql(found: str, budget: int) -> str:
    return f"""{found},
cn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, coalesce(page_start, 0), position) AS ref FROM fin_hits),
cb AS (SELECT *, '[' || ref || '] ' || trim(text, {BLANKS}) AS block FROM cn WHERE trim(text, {BLANKS}) <> ''),
cs AS (SELECT *, greatest(1, length(block) // 4) AS bt FROM cb),
cr AS (SELECT *, sum(bt) OVER (PARTITION BY query_id ORDER BY ref ROWS UNBOUNDED PRECEDING) AS total FROM cs),
cu AS (SELECT * FROM cr WHERE total <= {budget}),
cx AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY ref) AS context_text, count(*) AS chunks_used,
 CAST(sum(bt) AS BIGINT) AS total_tokens FROM cu GROUP BY query_id)"""


CONTEXT_SQL = context_sql(RETRIEVE_SQL, BUDGET)


def _blocks(spark, folder):
    return X.context_blocks(_retrieved(spark, folder), BUDGET)


@query("context_citations", f"""WITH {CONTEXT_SQL} SELECT query_id, CAST(ref AS INTEGER) AS ref, chunk_id, {SOURCE_SQL} AS source, score,
 left(trim(text, {BLANKS}), 150) AS text_preview FROM cu""")
def context_citations(spark, folder):
    return _blocks(spark, folder).select("query_id", "ref", "chunk_id", "source", "score", "text_preview")


@query("build_context", f"WITH {CONTEXT_SQL} SELECT query_id, md5(context_text) AS digest, chunks_used, total_tokens FROM cx")
def build_context(spark, folder):
    return X.build_context(_blocks(spark, folder)).select(
        "query_id", F.md5("context_text").alias("digest"), "chunks_used", "total_tokens")


def confidence_sql(packed: str) -> str:
    return f"""{packed},
cf0 AS (SELECT f.query_id, CAST(sum(CAST(round(score * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000 AS m, max(score) AS b, max(chunks_used) AS chunks_used
  FROM fin_hits f JOIN cx USING (query_id) WHERE position <= chunks_used GROUP BY f.query_id),
cf AS (SELECT *, round(least(1, 0.5::DOUBLE * m + 0.3::DOUBLE * least(1, chunks_used / {REQUESTED}) + 0.2::DOUBLE * CASE WHEN b >= 0.5 THEN least(1, b) ELSE b / 0.5::DOUBLE * 0.5::DOUBLE END), 2) AS confidence FROM cf0)"""


CONF_SQL = confidence_sql(CONTEXT_SQL)
TIER_SQL = "CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' WHEN confidence >= 0.4 THEN 'low' ELSE 'insufficient' END"


@query("confidence", f"""WITH {CONF_SQL} SELECT query_id, chunks_used, confidence, {TIER_SQL} AS tier, round(m, 3) AS retrieval_confidence,
 round(least(1, chunks_used / {REQUESTED}), 3) AS coverage_confidence, confidence >= 0.4 AS evidence_sufficient, round(b, 3) AS best_score FROM cf""")
def confidence(spark, folder):
    hits = _retrieved(spark, folder)
    return X.confidence(hits, X.build_context(X.context_blocks(hits, BUDGET)), REQUESTED)


def questions(spark, folder):
    """Question texts: the turns of users, some opened by a phrase a person would use."""
    openers = """element_at(array('', 'Compare this with peers: ', 'Give an overview of ', 'Why did M&A and R&D in AI fall? ',
      'What is the ROE, EPS and P/E? ', 'EBITDA vs. CAPEX: ', 'Explain ESG and AI risk for TCS and Apple. ', 'WIPRO AI AI OPEX '), cast(conv_id % 8 + 1 as int))"""
    return (table(spark, folder, "conversations").where("role = 'user'")
            .selectExpr("concat('Q', conv_id, '-', turn) AS question_id", f"concat({openers}, text) AS question",
                        "conv_id", "turn"))


QUESTION_SQL = """qn AS (SELECT 'Q' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS question_id, ['', 'Compare this with peers: ', 'Give an overview of ', 'Why did M&A and R&D in AI fall? ',
 'What is the ROE, EPS and P/E? ', 'EBITDA vs. CAPEX: ', 'Explain ESG and AI risk for TCS and Apple. ', 'WIPRO AI AI OPEX '][conv_id % 8 + 1] || text AS question,
 conv_id, turn FROM conversations WHERE role = 'user')"""


def class_sql(e, classes, default):
    return "CASE " + " ".join(
        "WHEN regexp_matches(trim(lower({})), '{}') THEN '{}'".format(e, "|".join(p).replace("'", "''"), n)
        for n, p in classes.items()) + f" ELSE '{default}' END"


QCLASS_SQL = class_sql("question", X.QUESTION_PATTERNS, "factual")


@query("classify_question", f"WITH {QUESTION_SQL} SELECT question_id, {QCLASS_SQL} AS question_type FROM qn")
def classify_question(spark, folder):
    return questions(spark, folder).select("question_id", X.classify_question("question").alias("question_type"))


def expand_sql(e):
    for short, longer in X.EXPANSIONS:
        e = f"regexp_replace({e}, '\\b{short}\\b', '{longer}')"
    return e


@query("expand_query", f"WITH {QUESTION_SQL} SELECT question_id, {expand_sql('question')} AS query_used FROM qn")
def expand_query(spark, folder):
    return questions(spark, folder).select("question_id", X.expand_query("question").alias("query_used"))


def embed_sql(ctes: str, source: str, text: str, name: str) -> str:
    """CTE `name`: the columns of `source` and `v`, the vector of `text`: signed counts of words in 64 slots, seven bits of each word's MD5."""
    return f"""{ctes}, {name}_w AS (SELECT *, list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'),
  lambda w: CAST('0x' || left(md5(w), 2) AS INTEGER) % 128) AS marks FROM {source}),
{name}_c AS (SELECT *, list_transform(range(64), lambda i: len(list_filter(marks, lambda m: m = i)) - len(list_filter(marks, lambda m: m = i + 64))) AS c FROM {name}_w),
{name}_n AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM {name}_c),
{name} AS (SELECT * EXCLUDE (marks, c, n), CASE WHEN {text} IS NULL THEN NULL WHEN n > 0 THEN list_transform(c, lambda x: CAST(x / n AS FLOAT)) ELSE [] END AS v FROM {name}_n)"""


ASKED_SQL = embed_sql(f"""{QUESTION_SQL}, qt AS (SELECT question_id AS query_id, question, {QCLASS_SQL} AS question_type, {expand_sql('question')} AS query_used,
 'SRC' || CAST(conv_id % 20 AS VARCHAR) AS company FROM qn)""", "qt", "query_used", "qe")


@query("embed_query", f"""WITH {ASKED_SQL} SELECT query_id AS question_id, CAST(len(v) AS INTEGER) AS dim,
 md5(array_to_string(list_transform(v, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)), ',')) AS digest FROM qe""")
def embed_query(spark, folder):
    q = questions(spark, folder).select("question_id", V.embed_fn(X.expand_query("question")).alias("v"))
    millionths = F.transform("v", lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string"))
    return q.select("question_id", F.size("v").alias("dim"), F.md5(F.array_join(millionths, ",")).alias("digest"))


@query("route_evidence", f"""WITH {CONTEXT_SQL}, all_q AS (SELECT query_id FROM qs)
SELECT query_id, CASE WHEN trim(coalesce(context_text, '')) = '' THEN 'insufficient' ELSE 'answer' END AS route FROM all_q LEFT JOIN cx USING (query_id)""")
def route_evidence(spark, folder):
    ctx = X.build_context(_blocks(spark, folder))
    return (section_queries(spark, folder).select("query_id").join(ctx, "query_id", "left")
            .select("query_id", X.route_evidence().alias("route")))


def document_chunks(spark, folder):
    """Every document as a chunk with its own text embedding, as a written vector table."""
    d = table(spark, folder, "documents")
    return materialize(d.select(
        F.format_string("doc%08d", "doc_id").alias("chunk_id"), F.concat(F.lit("D"), "doc_id").alias("document_id"),
        F.upper("source").alias("company"), F.lit(2024).alias("year"), F.lit("annual_report").alias("doc_type"),
        F.col("lang").alias("section"), F.lit(None).cast("string").alias("subsection"), F.lit(1).alias("page_start"),
        F.lit(1).alias("page_end"), "text", estimate_tokens("text").alias("token_count"), F.lit(False).alias("has_heading"),
        F.lit(False).alias("contains_table"), F.lit(0.85).alias("quality_score"), V.embed_fn("text").alias("embedding")
    ), "chunks").where(F.size("embedding") > 0)


def found_in_documents_sql(asked: str, top_k: int) -> str:
    """CTEs up to `fin_hits` over the documents of a query's company; `asked` ends in `qs` (query_id, company, v)."""
    docs = embed_sql(asked, "documents", "text", "dv")
    return f"""{docs},
vec AS (SELECT printf('doc%08d', doc_id) AS chunk_id, 'D' || CAST(doc_id AS VARCHAR) AS document_id, upper(source) AS company, 2024 AS year,
 'annual_report' AS doc_type, lang AS section, 1 AS page_start, 1 AS page_end, text, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_count,
 false AS has_heading, false AS contains_table, 0.85::DOUBLE AS quality_score, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS e FROM dv WHERE len(v) > 0),
sc AS (SELECT query_id, vec.*, round(list_dot_product(q, e) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(e, e)), 10) AS raw
  FROM (SELECT query_id, company, list_transform(v, lambda x: CAST(x AS DOUBLE)) AS q FROM qs WHERE len(v) > 0) q JOIN vec USING (company) WHERE token_count >= 20),
hit AS (SELECT *, round(raw, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id) AS rank FROM sc) WHERE rank <= {max(top_k * 4, 40)}),
{keep_sql(top_k)}"""


# --- embedding table ----------------------------------------------------------

@query("hash_text", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def hash_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", E.hash_text("text").alias("content_hash"))


def cache_rows(spark, folder, keep):
    d = table(spark, folder, "documents").where(keep)
    return d.select(
        E.hash_text("text").alias("content_hash"), F.format_string("doc%08d", "doc_id").alias("chunk_id"),
        F.array(F.col("doc_id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
        F.expr("if(doc_id % 2 = 0, 'hashing-64', 'other')").alias("embedding_model"), F.lit(1).alias("embedding_version"),
        F.expr("timestamp_seconds(doc_id)").alias("created_at"))


# The cache holds the documents of three quarters of the sources under two models.
CACHE_SQL = """ca AS (SELECT content_hash, embedding_model, max_by(doc_id, doc_id) AS doc_id FROM (
 SELECT sha256(text) AS content_hash, CASE WHEN doc_id % 2 = 0 THEN 'hashing-64' ELSE 'other' END AS embedding_model, doc_id
 FROM documents WHERE source NOT IN ('src1', 'src5', 'src9', 'src13', 'src17')) GROUP BY ALL)"""
CACHED = "source NOT IN ('src1', 'src5', 'src9', 'src13', 'src17')"


FULL_CACHE_SQL = CACHE_SQL.replace(" WHERE " + CACHED, "")


def _cache(spark, folder):
    """What the cache holds before a look-up."""
    rows = cache_rows(spark, folder, CACHED)
    return E.cache_put(rows.limit(0), rows)


@query("embedding_cache_put", f"WITH {FULL_CACHE_SQL} SELECT content_hash, embedding_model, doc_id FROM ca")
def embedding_cache_put(spark, folder):
    """Every document put on top of what the cache held."""
    return E.cache_put(_cache(spark, folder), cache_rows(spark, folder, "true")).select(
        "content_hash", "embedding_model", F.element_at("embedding", 1).cast("long").alias("doc_id"))


@query("stored_embedding_cache_put", f"WITH {FULL_CACHE_SQL} SELECT content_hash, embedding_model, doc_id FROM ca")
def stored_embedding_cache_put(spark, folder):
    """The same in a cache kept in versions: what it held, then every document."""
    rows = cache_rows(spark, folder, "true")
    kept = SnapshotTable(spark, f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}", rows.schema, E.CACHE_KEY, 16)
    E.store_cache(kept, cache_rows(spark, folder, CACHED))
    E.store_cache(kept, rows)
    return kept.read().select("content_hash", "embedding_model", F.element_at("embedding", 1).cast("long").alias("doc_id"))


@query("embedding_cache_lookup", f"""WITH {CACHE_SQL} SELECT d.doc_id, ca.doc_id IS NOT NULL AS hit, ca.doc_id AS cached_from
 FROM documents d LEFT JOIN ca ON ca.content_hash = sha256(d.text) AND ca.embedding_model = 'hashing-64'""")
def embedding_cache_lookup(spark, folder):
    chunks = table(spark, folder, "documents").select("doc_id", E.hash_text("text").alias("content_hash"))
    found = E.cache_lookup(chunks, _cache(spark, folder))
    return found.select("doc_id", F.col("cached_embedding").isNotNull().alias("hit"),
                        F.element_at("cached_embedding", 1).cast("long").alias("cached_from"))


@query("cache_stats", f"WITH {FULL_CACHE_SQL} SELECT count(*) AS total_entries, string_agg(DISTINCT embedding_model, ',' ORDER BY embedding_model) AS models FROM ca")
def cache_stats(spark, folder):
    return E.cache_stats(E.cache_put(_cache(spark, folder), cache_rows(spark, folder, "true")))


# A text has a vector unless each slot holds as many marks of the one sign as of the other, or none.
@query("embed_chunks", f"""WITH {CACHE_SQL}, looked AS (SELECT d.source, ca.doc_id IS NOT NULL AS hit, CASE WHEN ca.doc_id IS NULL THEN
  list_transform(regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: CAST('0x' || left(md5(w), 2) AS INTEGER) % 128) END AS marks
 FROM documents d LEFT JOIN ca ON ca.content_hash = sha256(d.text) AND ca.embedding_model = 'hashing-64'),
known AS (SELECT source, hit, coalesce(list_sort(list_filter(marks, lambda m: m < 64))
  <> list_sort(list_transform(list_filter(marks, lambda m: m >= 64), lambda m: m - 64)), false) AS has_vector FROM looked)
SELECT source, count(*) AS total, count(*) FILTER (NOT hit AND has_vector) AS embedded, count(*) FILTER (hit) AS cached,
 count(*) FILTER (NOT hit AND NOT has_vector) AS failed FROM known GROUP BY source""")
def embed_chunks(spark, folder):
    chunks = table(spark, folder, "documents").select("doc_id", "source", "text")
    return E.embed_counts(E.embed_chunks(chunks, _cache(spark, folder)), ["source"])


def _store(spark, folder):
    """The vector table before an update: the chunks of the first half of the years."""
    return vectors(spark, folder).select(*R.HIT_COLUMNS, "embedding").withColumn("pos", F.lit(0).cast("long"))


def _updates(spark, folder):
    """One update per vector: new ids, replaced ids, rows without an id and rows without a vector."""
    return vectors(spark, folder).select(
        F.expr("case when vec_id % 7 = 0 then '' when vec_id % 2 = 0 then chunk_id else concat('N', vec_id % 40) end").alias("chunk_id"),
        *[F.col(c) for c in R.HIT_COLUMNS[1:]],
        F.expr("if(vec_id % 9 = 0, array(), embedding)").cast("array<float>").alias("embedding"),
        (F.col("vec_id") + 1).alias("pos"))


UPSERT_SQL = f"""{VEC_SQL}, up AS (SELECT CASE WHEN vec_id % 7 = 0 THEN '' WHEN vec_id % 2 = 0 THEN chunk_id ELSE 'N' || CAST(vec_id % 40 AS VARCHAR) END AS chunk_id,
 document_id, vec_id + 1 AS pos FROM vec WHERE vec_id % 9 <> 0),
lu AS (SELECT chunk_id, max_by(document_id, pos) AS document_id, max(pos) AS pos FROM up WHERE chunk_id <> '' GROUP BY chunk_id),
st AS (SELECT chunk_id, document_id, CAST(0 AS BIGINT) AS pos FROM vec WHERE chunk_id NOT IN (SELECT chunk_id FROM lu) UNION ALL SELECT * FROM lu)"""


@query("vector_upsert", f"WITH {UPSERT_SQL} SELECT chunk_id, document_id, pos FROM st")
def vector_upsert(spark, folder):
    return E.vector_upsert(_store(spark, folder), _updates(spark, folder), "pos").select("chunk_id", "document_id", "pos")


@query("stored_vector_upsert", f"WITH {UPSERT_SQL} SELECT chunk_id, document_id, pos FROM st")
def stored_vector_upsert(spark, folder):
    """The same in a table kept in versions; the second batch is sent twice, as after a failure."""
    store = _store(spark, folder)
    kept = SnapshotTable(spark, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}", store.schema, ["chunk_id"], 16)
    for batch, rows in enumerate([store, _updates(spark, folder), _updates(spark, folder)]):
        E.store_vectors(kept, rows, "pos", "queries", min(batch, 1))
    return kept.read().select("chunk_id", "document_id", "pos")


@query("vector_upsert_counts", """SELECT count(*) FILTER (vec_id % 7 <> 0 AND vec_id % 9 <> 0) AS uploaded,
 count(*) FILTER (vec_id % 7 = 0 OR vec_id % 9 = 0) AS skipped, CAST(0 AS BIGINT) AS failed FROM embeddings""")
def vector_upsert_counts(spark, folder):
    return E.upsert_counts(_updates(spark, folder))


@query("vector_delete_by_document", f"""WITH {VEC_SQL} SELECT chunk_id, document_id FROM vec WHERE document_id NOT IN (
 SELECT 'D' || CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""")
def vector_delete_by_document(spark, folder):
    gone = table(spark, folder, "labels").where("toxic = 1").select(F.concat(F.lit("D"), "doc_id").alias("document_id"))
    return E.vector_delete_by_document(vectors(spark, folder), gone).select("chunk_id", "document_id")


@query("collection_info", "SELECT count(*) AS points_count, CAST(max(len(embedding)) AS INTEGER) AS vector_size, 'Cosine' AS distance FROM embeddings")
def collection_info(spark, folder):
    return E.collection_info(vectors(spark, folder))


@query("safe_or", """SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_retailprice END, 0), p_size) AS value FROM part""")
def safe_or_query(spark, folder):
    part = table(spark, folder, "part")
    first = F.expr("case when p_partkey % 3 = 0 then 0D when p_partkey % 3 = 1 then p_retailprice else p_retailprice end")
    return part.select("p_partkey", safe_or(first, F.col("p_size").cast("double")).alias("value"))
