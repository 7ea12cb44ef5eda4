"""Queries over page text: cleaning and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.pages import PAGES_SQL, document_pages
from ledgerloom.catalog.registry import query
from ledgerloom.functions import text as T
from ledgerloom.operators import chunking as K
from ledgerloom.operators import cleaning as C
from ledgerloom.session import materialize

IDS = ["document_id", "page"]
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233) || chr(8195) || chr(8194) || chr(8201) || chr(12288)"


def trim_sql(e: str) -> str:
    return f"trim({e}, {WS})"


def lines_sql(e: str) -> str:
    return f"string_split({e}, chr(10))"


def filter_sql(e: str, keep: str) -> str:
    return f"array_to_string(list_filter({lines_sql(e)}, lambda l: {keep}), chr(10))"


def page_query(name, sql_expr, column):
    """A step applied to every page; compared by length and digest of the whole text."""
    sql = (f"WITH {PAGES_SQL}, r AS (SELECT document_id, page, {sql_expr} AS t FROM pg) "
           "SELECT document_id, page, length(t) AS size, md5(t) AS digest FROM r")

    @query(name, sql)
    def run(spark, folder):
        out = document_pages(spark, folder).select(*IDS, column("text").alias("t"))
        return out.select(*IDS, F.length("t").cast("long").alias("size"), F.md5("t").alias("digest"))


CONTROL_SQL = r"regexp_replace({}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|\p{{Cf}}|\p{{Co}}', '', 'g')"
ARTIFACT_SQL = r"'^(https?://\S+|http://fasb\.org/.*|http://xbrl\.org/.*|\d{10}|P\d+[YMWD]|(?i:true|false)|[a-z]+-\d{8}|0{5,}\d+)$'"
PAGENO_SQL = r"'(?i)^(-?\s*\d{1,4}\s*-?|page\s+\d{1,4}(\s+of\s+\d{1,4})?|[ivxlcdm]+)$'"


def xbrl_sql(e):
    return filter_sql(e, f"NOT regexp_matches({trim_sql('l')}, {ARTIFACT_SQL})")


def space_sql(e):
    single = f"regexp_replace(replace({e}, chr(9), ' '), ' {{2,}}', ' ', 'g')"
    return f"array_to_string(list_transform({lines_sql(single)}, lambda l: rtrim(l, {WS})), chr(10))"


def pageno_sql(e):
    return filter_sql(e, f"NOT regexp_matches({trim_sql('l')}, {PAGENO_SQL})")


def paragraphs_sql(e):
    return trim_sql(f"regexp_replace({e}, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")


HEAD_SQL = (r"'^((?i:PART|ITEM|SECTION|CHAPTER|SCHEDULE|ANNEXURE|EXHIBIT)\s|[A-Z][A-Z\s&,\-]{5,}$|\d+[.)]\s+[A-Z]"
            r"|[ivxIVX]+[.)]\s|(?i:Notes?)\s+\d)'")
BULLET_SQL = "'^([-•‣▪◦●○■□–—➢*]\\s|\\d+[.)]\\s|[a-z][.)]\\s|\\((?i:[a-z0-9ivx]+)\\)\\s)'"
GROUP_SQL = "'[$₹]?\\s*[\\d,]+\\.?\\d*'"


def table_line_sql(e):
    return f"(contains({e}, '|') OR length(regexp_extract_all({e}, {GROUP_SQL})) >= 3)"


def broken_sql(e):
    """The same fold in SQL: the text built so far is the accumulator."""
    cur = f"rtrim(regexp_extract(acc, '[^\\n]*$'), {WS})"
    n = trim_sql("x")
    merge = (f"{cur} <> '' AND {n} <> '' AND NOT regexp_matches({cur}, '[.!?;:]$') AND length({trim_sql(cur)}) >= 20 "
             f"AND NOT regexp_matches({n}, {HEAD_SQL}) AND NOT regexp_matches({n}, {BULLET_SQL}) "
             f"AND NOT {table_line_sql(cur)} AND NOT {table_line_sql(n)} AND regexp_matches({n}, '^\\p{{Ll}}')")
    joined = (f"CASE WHEN ends_with({cur}, '-') THEN regexp_replace(acc, '-\\s*$', '') || {n} "
              f"ELSE rtrim(acc, {WS}) || ' ' || {n} END")
    return f"list_reduce({lines_sql(e)}, lambda acc, x: CASE WHEN {merge} THEN {joined} ELSE acc || chr(10) || x END)"


page_query("normalize_unicode", "nfc_normalize(text)", C.normalize_unicode)
page_query("remove_control_characters", CONTROL_SQL.format("text"), C.remove_control_characters)
page_query("remove_xbrl_artifacts", xbrl_sql("text"), C.remove_xbrl_artifacts)
page_query("normalize_whitespace", space_sql("text"), C.normalize_whitespace)
page_query("remove_page_numbers", pageno_sql("text"), C.remove_page_numbers)
page_query("fix_broken_lines", broken_sql("text"), C.fix_broken_lines)
page_query("normalize_paragraphs", paragraphs_sql("text"), C.normalize_paragraphs)

REPEATED_SQL = f"""{PAGES_SQL},
edge AS (SELECT document_id, page, {lines_sql(trim_sql('text'))} AS ls FROM pg),
sided AS (SELECT document_id, page, 'header' AS side, unnest(ls[1:3]) AS l, generate_subscripts(ls[1:3], 1) AS i FROM edge
 UNION ALL SELECT document_id, page, 'footer', unnest(ls[-3:]), generate_subscripts(ls[-3:], 1) FROM edge),
pat AS (SELECT document_id, page, side, i, {trim_sql('l')} AS s, regexp_replace({trim_sql('l')}, '\\d+', '#', 'g') AS p FROM sided),
cnt AS (SELECT document_id, side, p AS pattern, count(*) AS hits FROM pat a WHERE s <> '' AND NOT EXISTS (
  SELECT 1 FROM pat b WHERE b.document_id = a.document_id AND b.page = a.page AND b.side = a.side AND b.i < a.i AND b.p = a.s)
 GROUP BY ALL),
np AS (SELECT document_id, count(*) AS n FROM pg GROUP BY 1),
rep AS (SELECT document_id, side, pattern, hits FROM cnt JOIN np USING (document_id)
 WHERE n >= 5 AND hits >= greatest(5, CAST(floor(n * 0.4::DOUBLE) AS BIGINT)))"""


@query("detect_repeated_headers", f"WITH {REPEATED_SQL} SELECT document_id, pattern, hits FROM rep WHERE side = 'header'")
def detect_repeated_headers(spark, folder):
    return (C.repeated_lines(document_pages(spark, folder)).where(F.col("side") == "header")
            .select("document_id", "pattern", "hits"))


@query("detect_repeated_footers", f"WITH {REPEATED_SQL} SELECT document_id, pattern, hits FROM rep WHERE side = 'footer'")
def detect_repeated_footers(spark, folder):
    return (C.repeated_lines(document_pages(spark, folder)).where(F.col("side") == "footer")
            .select("document_id", "pattern", "hits"))


def repeated_sql(e, patterns):
    return filter_sql(e, f"{trim_sql('l')} = '' OR NOT list_contains({patterns}, regexp_replace({trim_sql('l')}, '\\d+', '#', 'g'))")


PER_DOC_SQL = f"""{REPEATED_SQL}, pd AS (SELECT document_id, page, text,
 coalesce((SELECT list(pattern) FROM rep r WHERE r.document_id = pg.document_id AND side = 'header'), []) AS hp,
 coalesce((SELECT list(pattern) FROM rep r WHERE r.document_id = pg.document_id AND side = 'footer'), []) AS fp FROM pg)"""


@query("remove_repeated_lines", f"""WITH {PER_DOC_SQL}, r AS (SELECT document_id, page, {repeated_sql('text', 'hp')} AS t FROM pd)
SELECT document_id, page, length(t) AS size, md5(t) AS digest FROM r""")
def remove_repeated_lines(spark, folder):
    pages = document_pages(spark, folder)
    patterns = C.patterns_per_document(C.repeated_lines(pages))
    out = pages.join(patterns, "document_id", "left").select(*IDS, C.remove_repeated_lines("text", "headers").alias("t"))
    return out.select(*IDS, F.length("t").cast("long").alias("size"), F.md5("t").alias("digest"))


CLEAN_SQL = f"""{PER_DOC_SQL},
c1 AS (SELECT *, {xbrl_sql(CONTROL_SQL.format('nfc_normalize(text)'))} AS t1 FROM pd),
c2 AS (SELECT *, {space_sql('t1')} AS t2 FROM c1),
c3 AS (SELECT *, {repeated_sql('t2', 'hp')} AS t3 FROM c2),
c4 AS (SELECT *, {repeated_sql('t3', 'fp')} AS t4 FROM c3),
c5 AS (SELECT *, {pageno_sql('t4')} AS t5 FROM c4),
c6 AS (SELECT *, {broken_sql('t5')} AS t6 FROM c5),
cl AS (SELECT document_id, page, text AS raw_text, hp, fp, {paragraphs_sql('t6')} AS clean_text FROM c6)"""


@query("clean_page", f"WITH {CLEAN_SQL} SELECT document_id, page, length(clean_text) AS size, md5(clean_text) AS digest FROM cl")
def clean_page(spark, folder):
    out = C.clean_document(document_pages(spark, folder))
    return out.select(*IDS, F.length("clean_text").cast("long").alias("size"), F.md5("clean_text").alias("digest"))


@query("clean_document", f"""WITH {CLEAN_SQL}, st AS (SELECT document_id, count(*) AS total_pages,
 CAST(sum(length(raw_text)) AS BIGINT) AS raw_characters, CAST(sum(length(clean_text)) AS BIGINT) AS clean_characters,
 CAST(max(len(hp)) AS INTEGER) AS headers_detected, CAST(max(len(fp)) AS INTEGER) AS footers_detected,
 count(*) FILTER ({trim_sql('clean_text')} = '') AS empty_pages FROM cl GROUP BY 1)
SELECT *, CASE WHEN raw_characters > 0 THEN round((raw_characters - clean_characters) / raw_characters * 100, 1) ELSE 0 END AS reduction_pct FROM st""")
def clean_document(spark, folder):
    return C.clean_statistics(C.clean_document(document_pages(spark, folder)))


# --- chunking -----------------------------------------------------------------

HEADING_CASE_SQL = f"""CASE WHEN s = '' OR length(s) > 120 OR (length(s) > 80 AND NOT (starts_with(s, 'ITEM ') OR starts_with(s, 'PART ') OR starts_with(s, 'SECTION '))) THEN 0
 WHEN regexp_matches(s, '(?i)^PART\\s+[IVXLC]+\\b') THEN 195
 WHEN regexp_matches(s, '(?i)^ITEM\\s+\\d+[A-Z]?\\.?\\s') THEN 295 WHEN regexp_matches(s, '(?i)^SECTION\\s+\\d+') THEN 290
 WHEN regexp_matches(s, '(?i)^SCHEDULE\\s+[IVXLC\\d]+') THEN 285 WHEN regexp_matches(s, '(?i)^(ANNEXURE|EXHIBIT)\\s+[A-Z\\d]') THEN 285
 WHEN regexp_matches(s, '^[A-Z][A-Z\\s&,\\-''/()]{{4,79}}$') THEN 275
 WHEN regexp_matches(s, '(?i)^Notes?\\s+\\d') THEN 385 WHEN regexp_matches(s, '^\\d+\\.\\d+\\.?\\s+[A-Z]') THEN 370 ELSE 0 END"""
TABLE_CASE_SQL = """(s <> '' AND (length(s) - length(replace(s, '|', '')) >= 2
 OR length(regexp_extract_all(s, '[$₹€¥]?\\s*[\\d,]+\\.?\\d*')) >= 3 OR length(regexp_extract_all(s, '\\S+\\s{3,}')) >= 2))"""
LINES_SQL = f"""{PAGES_SQL}, ln AS (SELECT document_id, page, unnest({lines_sql('text')}) AS l, generate_subscripts({lines_sql('text')}, 1) AS line_no FROM pg),
sc AS (SELECT document_id, page, line_no, {trim_sql('l')} AS s FROM ln)"""


@query("estimate_tokens", f"WITH {PAGES_SQL} SELECT document_id, page, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM pg")
def estimate_tokens(spark, folder):
    return document_pages(spark, folder).select(*IDS, K.estimate_tokens("text").alias("tokens"))


@query("heading_score", f"""WITH {LINES_SQL}, h AS (SELECT document_id, page, {HEADING_CASE_SQL} AS h FROM sc)
SELECT document_id, page, CAST(h // 100 AS INTEGER) AS level, count(*) AS n, CAST(sum(h % 100) AS BIGINT) AS confidence FROM h GROUP BY ALL""")
def heading_score(spark, folder):
    lines = document_pages(spark, folder).select(*IDS, F.explode(T.lines_of("text")).alias("line"))
    scored = lines.select(*IDS, K.heading_score(F.col("line")).alias("h"))
    return scored.groupBy(*IDS, F.col("h.level").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("h.confidence") * 100).cast("long")).alias("confidence"))


@query("is_table_row", f"""WITH {LINES_SQL} SELECT document_id, page, count(*) FILTER ({TABLE_CASE_SQL}) AS table_rows, count(*) AS lines FROM sc GROUP BY ALL""")
def is_table_row(spark, folder):
    lines = document_pages(spark, folder).select(*IDS, F.explode(T.lines_of("text")).alias("line"))
    return lines.groupBy(*IDS).agg(F.count_if(K.is_table_row(F.col("line"))).alias("table_rows"),
                                   F.count(F.lit(1)).alias("lines"))


def blocks_sql(lines: str) -> str:
    """CTEs `bl` and `bs`: blocks and their sections from `sc`, the trimmed lines."""
    return f"""{lines}, k AS (SELECT *, {HEADING_CASE_SQL} AS h, {TABLE_CASE_SQL} AS tb FROM sc),
kk AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN h > 0 THEN 'heading' WHEN tb THEN 'table' ELSE 'paragraph' END AS kind FROM k),
kp AS (SELECT *, lag(kind) OVER (PARTITION BY document_id ORDER BY page, line_no) AS pk FROM kk),
kb AS (SELECT *, sum(CASE WHEN kind <> 'blank' AND (kind = 'heading' OR pk IS NULL OR pk <> kind) THEN 1 ELSE 0 END)
 OVER (PARTITION BY document_id ORDER BY page, line_no) AS b FROM kp),
bl AS (SELECT document_id, CAST(b - 1 AS BIGINT) AS block_no, {trim_sql("string_agg(s, chr(10) ORDER BY page, line_no)")} AS text,
 string_agg(DISTINCT page, ',' ORDER BY page) AS pages, any_value(kind) AS block_type,
 CAST(max(h // 100) AS INTEGER) AS heading_level, min(page) AS first_page, max(page) AS last_page FROM kb WHERE kind <> 'blank' GROUP BY document_id, b),
bs AS (SELECT *, last_value(CASE WHEN heading_level IN (1, 2) THEN text END IGNORE NULLS) OVER w AS section,
 max(CASE WHEN heading_level IN (1, 2) THEN block_no END) OVER w AS sec_no, max(CASE WHEN heading_level = 3 THEN block_no END) OVER w AS sub_no,
 last_value(CASE WHEN heading_level = 3 THEN text END IGNORE NULLS) OVER w AS sub
 FROM bl WINDOW w AS (PARTITION BY document_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


BLOCKS_SQL = blocks_sql(LINES_SQL)


@query("parse_blocks", f"WITH {BLOCKS_SQL} SELECT document_id, block_no, md5(text) AS digest, pages, block_type, heading_level FROM bl")
def parse_blocks(spark, folder):
    return K.parse_blocks(document_pages(spark, folder), "text").select(
        "document_id", "block_no", F.md5("text").alias("digest"),
        F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "block_type", "heading_level")


@query("assign_sections", f"""WITH {BLOCKS_SQL} SELECT document_id, block_no, coalesce(section, '') AS section,
 CASE WHEN sub_no > coalesce(sec_no, -1) THEN sub ELSE '' END AS subsection FROM bs""")
def assign_sections(spark, folder):
    return K.assign_sections(K.parse_blocks(document_pages(spark, folder), "text")).select(
        "document_id", "block_no", "section", "subsection")


def _blocks(spark, folder):
    return K.assign_sections(K.parse_blocks(C.clean_document(document_pages(spark, folder))))


def tokens_sql(e: str) -> str:
    return f"CAST(greatest(1, length({e}) // 4) AS INTEGER)"


# The builder is a fold over three events for each block (may seal, add, may seal) and a last one that seals.
SEAL_SQL = """(len(a.parts) > 0 AND CASE x.ev WHEN 1 THEN CASE WHEN x.major THEN true WHEN x.kind = 'paragraph' THEN a.tokens + x.size > 1200 AND a.tokens >= 300 ELSE a.tokens >= 300 END
 WHEN 3 THEN x.kind <> 'heading' AND a.tokens >= 800 WHEN 4 THEN true ELSE false END)"""
CARRY_SQL = f"(CASE x.ev WHEN 1 THEN NOT x.major WHEN 3 THEN x.kind = 'paragraph' ELSE false END AND {tokens_sql('a.parts[-1]')} <= 150)"
CHUNK_TYPE = "STRUCT(section VARCHAR, subsection VARCHAR, page_start INTEGER, page_end INTEGER, text VARCHAR, token_count INTEGER, has_heading BOOLEAN, contains_table BOOLEAN)"
STATE_TYPE = f"STRUCT(done {CHUNK_TYPE}[], parts VARCHAR[], tokens INTEGER, p0 INTEGER, p1 INTEGER, heading BOOLEAN, tbl BOOLEAN, sec VARCHAR, sub VARCHAR)"


def _of_event(add: str, sealed: str, same: str) -> str:
    return f"CASE WHEN x.ev = 2 THEN {add} WHEN {SEAL_SQL} THEN {sealed} ELSE {same} END"


STEP_SQL = f"""CAST({{
 'done': CASE WHEN {SEAL_SQL} THEN list_append(a.done, CAST({{'section': a.sec, 'subsection': a.sub, 'page_start': a.p0, 'page_end': a.p1, 'text': array_to_string(a.parts, chr(10) || chr(10)),
   'token_count': {tokens_sql("array_to_string(a.parts, chr(10) || chr(10))")}, 'has_heading': a.heading, 'contains_table': a.tbl}} AS {CHUNK_TYPE})) ELSE a.done END,
 'parts': {_of_event("list_append(a.parts, x.text)", f"CASE WHEN {CARRY_SQL} THEN a.parts[-1:] ELSE [] END", "a.parts")},
 'tokens': {_of_event("a.tokens + x.size", f"CASE WHEN {CARRY_SQL} THEN {tokens_sql('a.parts[-1]')} ELSE 0 END", "a.tokens")},
 'p0': {_of_event("least(a.p0, x.p0)", "NULL", "a.p0")}, 'p1': {_of_event("greatest(a.p1, x.p1)", "NULL", "a.p1")},
 'heading': {_of_event("a.heading OR x.kind = 'heading'", "false", "a.heading")}, 'tbl': {_of_event("a.tbl OR x.kind = 'table'", "false", "a.tbl")},
 'sec': CASE WHEN x.ev = 2 AND (x.kind <> 'table' OR a.sec IS NULL) THEN x.section ELSE a.sec END,
 'sub': CASE WHEN x.ev = 2 AND (x.kind <> 'table' OR a.sec IS NULL) THEN x.subsection ELSE a.sub END}} AS {STATE_TYPE})"""
BUILD_SQL = blocks_sql(f"""{CLEAN_SQL}, ln AS (SELECT document_id, page, unnest({lines_sql('clean_text')}) AS l, generate_subscripts({lines_sql('clean_text')}, 1) AS line_no FROM cl),
sc AS (SELECT document_id, page, line_no, {trim_sql('l')} AS s FROM ln)""") + f""",
b0 AS (SELECT document_id, block_no, block_type AS kind, text, {tokens_sql('text')} AS size, first_page AS p0, last_page AS p1, heading_level IN (1, 2) AS major,
 coalesce(section, '') AS section, CASE WHEN sub_no > coalesce(sec_no, -1) THEN sub ELSE '' END AS subsection FROM bs),
b1 AS (SELECT *, CASE WHEN kind <> 'heading' AND size >= 800 THEN 1 ELSE 0 END AS heavy FROM b0),
b2 AS (SELECT *, CAST(sum(CASE WHEN major THEN 1 ELSE 0 END + heavy) OVER (PARTITION BY document_id ORDER BY block_no) - heavy AS BIGINT) AS segment FROM b1),
ev AS (SELECT document_id, segment, block_no, unnest([1, 2, 3]) AS ev, kind, text, size, p0, p1, major, section, subsection FROM b2
 UNION ALL SELECT DISTINCT document_id, segment, 9223372036854775807, 4, '', '', 0, 0, 0, false, '', '' FROM b2),
el AS (SELECT document_id, segment, list({{'ev': ev, 'kind': kind, 'text': text, 'size': size, 'p0': p0, 'p1': p1, 'major': major, 'section': section, 'subsection': subsection}} ORDER BY block_no, ev) AS xs
 FROM ev GROUP BY document_id, segment),
bu AS (SELECT document_id, segment, list_reduce(xs, lambda a, x: {STEP_SQL},
 CAST({{'done': [], 'parts': [], 'tokens': 0, 'p0': NULL, 'p1': NULL, 'heading': false, 'tbl': false, 'sec': NULL, 'sub': NULL}} AS {STATE_TYPE})) AS st FROM el),
bc AS (SELECT document_id, segment, unnest(st.done) AS c, generate_subscripts(st.done, 1) AS nth FROM bu)"""
FIELDS_SQL = "c.section AS section, c.subsection AS subsection, c.page_start AS page_start, c.page_end AS page_end, c.text AS text, c.token_count AS token_count, c.has_heading AS has_heading, c.contains_table AS contains_table"

# Sentences of a chunk that is too long, filled up greedily.
FILL_TYPE = "STRUCT(done VARCHAR[], held VARCHAR[], size INTEGER)"
SPLIT_SQL = f"""{BUILD_SQL},
se AS (SELECT *, CASE WHEN c.token_count > 1200 THEN string_split(regexp_replace(c.text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS sentences FROM bc),
fi AS (SELECT document_id, segment, nth, c, list_reduce(sentences, lambda a, s: CASE WHEN len(a.held) > 0 AND a.size + {tokens_sql('s')} > 1200
  THEN CAST({{'done': list_append(a.done, array_to_string(a.held, ' ')), 'held': [s], 'size': {tokens_sql('s')}}} AS {FILL_TYPE})
  ELSE CAST({{'done': a.done, 'held': list_append(a.held, s), 'size': a.size + {tokens_sql('s')}}} AS {FILL_TYPE}) END,
 CAST({{'done': [], 'held': [], 'size': 0}} AS {FILL_TYPE})) AS f FROM se),
pc AS (SELECT document_id, segment, nth, c, unnest(CASE WHEN f IS NULL THEN [c.text] ELSE list_append(f.done, array_to_string(f.held, ' ')) END) AS piece,
 generate_subscripts(CASE WHEN f IS NULL THEN [c.text] ELSE list_append(f.done, array_to_string(f.held, ' ')) END, 1) AS part FROM fi),
sp AS (SELECT document_id, segment, row_number() OVER (PARTITION BY document_id, segment ORDER BY nth, part) - 1 AS idx,
 CAST({{'section': c.section, 'subsection': c.subsection, 'page_start': c.page_start, 'page_end': c.page_end, 'text': piece, 'token_count': {tokens_sql('piece')},
  'has_heading': c.has_heading, 'contains_table': c.contains_table}} AS {CHUNK_TYPE}) AS c FROM pc)"""

# A chunk below the minimum takes in the next one.
HELD_TYPE = f"STRUCT(segment BIGINT, idx BIGINT, c {CHUNK_TYPE})"
MERGE_TYPE = f"STRUCT(done {HELD_TYPE}[], held {HELD_TYPE})"
BOTH_SQL = "a.held.c.text || chr(10) || chr(10) || x.c.text"
MERGE_SQL = f"""{SPLIT_SQL},
ml AS (SELECT document_id, count(*) AS n_chunks, list(CAST({{'segment': segment, 'idx': idx, 'c': c}} AS {HELD_TYPE}) ORDER BY segment, idx) AS xs FROM sp GROUP BY document_id),
mr AS (SELECT document_id, n_chunks, list_reduce(xs, lambda a, x: CASE WHEN a.held IS NOT NULL AND a.held.c.token_count < 300
  THEN CAST({{'done': a.done, 'held': {{'segment': a.held.segment, 'idx': a.held.idx, 'c': {{'section': coalesce(nullif(a.held.c.section, ''), x.c.section),
   'subsection': coalesce(nullif(x.c.subsection, ''), a.held.c.subsection), 'page_start': a.held.c.page_start, 'page_end': coalesce(x.c.page_end, a.held.c.page_end),
   'text': {BOTH_SQL}, 'token_count': {tokens_sql(BOTH_SQL)}, 'has_heading': a.held.c.has_heading OR x.c.has_heading, 'contains_table': a.held.c.contains_table OR x.c.contains_table}}}}}} AS {MERGE_TYPE})
  ELSE CAST({{'done': CASE WHEN a.held IS NULL THEN a.done ELSE list_append(a.done, a.held) END, 'held': x}} AS {MERGE_TYPE}) END,
 CAST({{'done': [], 'held': NULL}} AS {MERGE_TYPE})) AS m FROM ml),
mu AS (SELECT document_id, n_chunks, unnest(list_append(m.done, m.held)) AS k FROM mr),
mg AS (SELECT document_id, k.segment AS segment, k.idx AS idx, k.c AS c FROM mu WHERE n_chunks = 1 OR k.c.token_count >= 30 OR length({trim_sql('k.c.text')}) >= 100),
fn AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY segment, idx) AS chunk_no, {FIELDS_SQL} FROM mg)"""
CHUNKED_SQL = f"""WITH {MERGE_SQL} SELECT printf('%s_chunk_%03d', document_id, chunk_no) AS chunk_id, *, round(least(1::DOUBLE, greatest(0::DOUBLE, 0.7::DOUBLE
 + CASE WHEN token_count BETWEEN 300 AND 1200 THEN 0.15::DOUBLE WHEN token_count < 100 THEN -0.3::DOUBLE WHEN token_count < 300 THEN -0.1::DOUBLE ELSE -0.15::DOUBLE END
 + CASE WHEN section <> '' THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN has_heading THEN 0.05::DOUBLE ELSE 0 END
 + CASE WHEN page_start IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END)), 2) AS quality_score FROM fn"""


@query("build_chunks", f"WITH {BUILD_SQL} SELECT document_id, segment, nth - 1 AS idx, {FIELDS_SQL} FROM bc")
def build_chunks(spark, folder):
    return K.build_chunks(_blocks(spark, folder), split=False)


@query("split_oversized", f"WITH {SPLIT_SQL} SELECT document_id, segment, idx, {FIELDS_SQL} FROM sp")
def split_oversized(spark, folder):
    return K.build_chunks(_blocks(spark, folder))


@query("merge_undersized", f"WITH {MERGE_SQL} SELECT document_id, segment, idx, {FIELDS_SQL} FROM mg")
def merge_undersized(spark, folder):
    return K.merge_undersized(K.build_chunks(_blocks(spark, folder)))


@query("chunk_document", CHUNKED_SQL)
def chunk_document(spark, folder):
    pages = document_pages(spark, folder)
    return K.chunk_document(C.clean_document(pages), page_rows=pages)


@query("quality_score", """SELECT doc_id, round(least(1::DOUBLE, greatest(0::DOUBLE, 0.7::DOUBLE
 + CASE WHEN n BETWEEN 300 AND 1200 THEN 0.15::DOUBLE WHEN n < 100 THEN -0.3::DOUBLE WHEN n < 300 THEN -0.1::DOUBLE ELSE -0.15::DOUBLE END
 + CASE WHEN lang <> 'en' THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0.05::DOUBLE ELSE 0 END
 + CASE WHEN doc_id % 5 <> 0 THEN 0.05::DOUBLE ELSE 0 END)), 2) AS quality_score
 FROM (SELECT *, greatest(1, length(text) // 4) AS n FROM documents)""")
def quality_score(spark, folder):
    from ledgerloom.tables import table
    d = table(spark, folder, "documents").select(
        "doc_id", K.estimate_tokens("text").alias("token_count"),
        F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("section"),
        (F.col("doc_id") % 3 == 0).alias("has_heading"),
        F.when(F.col("doc_id") % 5 != 0, F.lit(1)).alias("page_start"))
    return d.select("doc_id", K.quality_score().alias("quality_score"))


@query("chunk_text", f"WITH {MERGE_SQL} SELECT document_id, chunk_no, section, token_count, md5(text) AS digest FROM fn")
def chunk_text(spark, folder):
    """The chunker as a table function called from SQL."""
    K.register(spark)
    K.page_blocks(C.clean_document(document_pages(spark, folder))).createOrReplaceTempView("page_blocks")
    return spark.sql("SELECT document_id, chunk_no, section, token_count, md5(text) AS digest FROM chunk_text(TABLE(page_blocks))")


@query("chunk_huge_document", CHUNKED_SQL)
def chunk_huge_document(spark, folder):
    """The way for documents too long for one task, taken here for every document."""
    return K.chunk_document(C.clean_document(document_pages(spark, folder)), whole_document_pages=0)


@query("chunk_summary", f"""WITH {MERGE_SQL}, tt AS (SELECT document_id, count(*) AS total_chunks, CAST(sum(token_count) AS BIGINT) AS total_tokens, round(avg(token_count), 1) AS avg_chunk_tokens FROM fn GROUP BY 1),
hd AS (SELECT document_id, text, min(block_no) AS first_no FROM bl WHERE heading_level IN (1, 2) GROUP BY 1, 2),
hs AS (SELECT document_id, count(*) AS n_sections, min_by(text, first_no) AS first_section, list(text ORDER BY first_no) AS sections FROM hd GROUP BY 1)
SELECT tt.*, n_sections, first_section, sections FROM tt LEFT JOIN hs ON hs.document_id = tt.document_id""")
def chunk_summary(spark, folder):
    pages = document_pages(spark, folder)
    # Read by chunks and headings, hence written once.
    paged = materialize(K.page_blocks(C.clean_document(pages)), "page-blocks")
    return K.chunk_summary(K.chunk_paged(paged, pages), K.headings(paged))
