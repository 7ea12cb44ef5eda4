"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

# The control strings of the chat template, spelled out here once more.
_CONTROL = ("<|start|>", "<|message|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _escaped(column: str) -> str:
    sql = rf"replace({column}, '\', '\\')"
    for c in _CONTROL:
        sql = rf"replace({sql}, '{c}', '{c[0]}\{c[1:]}')"
    return sql


CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(9 + length({_escaped('role')}) + 11 + length({_escaped('text')}) + 7 + 1) AS BIGINT) AS formatted_chars,
 count(*) FILTER (role = 'assistant') AS n_examples FROM t GROUP BY conv_id"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
ph AS (SELECT DISTINCT item_id, ws[i:i + least(len(ws), 10) - 1] AS terms FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
po AS (SELECT doc_id, ws, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM d),
n AS (SELECT term, count(*) AS n FROM po GROUP BY term),
pt AS (SELECT item_id, terms, unnest(terms) AS term, generate_subscripts(terms, 1) AS place FROM ph),
best AS (SELECT item_id, terms, min((coalesce(n.n, 0), pt.term, place)) AS m FROM pt LEFT JOIN n USING (term) GROUP BY ALL),
rare AS (SELECT item_id, terms, m[2] AS term, m[3] AS place FROM best),
hit AS (SELECT doc_id, item_id, pos - place + 1 AS start, len(terms) AS n, pos - place >= 0 AND ws[greatest(pos - place + 1, 1):pos - place + len(terms)] = terms AS exact,
 len(terms) > 3 AND len(list_filter(list_distinct(terms), lambda x: NOT list_contains(ws[greatest(pos - 9, 1):pos + 9], x))) <= 2 AS near FROM po JOIN rare USING (term)),
per AS (SELECT doc_id, count(DISTINCT item_id) FILTER (exact) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) FILTER (exact) AS items,
 count(DISTINCT item_id) FILTER (near) AS n_near_items FROM hit GROUP BY doc_id),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + n)) AS p FROM hit WHERE exact) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items FROM d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN cov ON cov.doc_id = d.doc_id"""

NEAREST = """WITH v AS (SELECT row_number() OVER () AS rn, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.rn, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_PIECES = r"regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')"
COLLOCATIONS = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest({_PIECES}) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, ws[i:i + k - 1] AS said, count(*) AS a FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(ws) >= k) GROUP BY ALL),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cut AS (SELECT c.lang, c.said, c.a, x.l, y.r, CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.l AS HUGEINT) * y.r) AS BIGINT) AS score, c.place FROM (SELECT *, unnest(range(1, k)) AS place FROM c) c
 JOIN (SELECT lang, said, a AS l FROM f) x ON x.lang = c.lang AND x.said = c.said[1:c.place] JOIN (SELECT lang, said, a AS r FROM f) y ON y.lang = c.lang AND y.said = c.said[c.place + 1:c.k]),
best AS (SELECT lang, said, a, min((score, place, l, r)) AS m FROM cut GROUP BY ALL),
held AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([said[1:2], said[2:3]]) AS part FROM c WHERE k = 3) GROUP BY ALL),
left_over AS (SELECT best.* FROM best LEFT JOIN held ON held.lang = best.lang AND held.part = best.said WHERE longer IS NULL OR 100 * longer < 50 * a),
r AS (SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY m[1] DESC, a DESC, array_to_string(said, ' ')) AS rank, array_to_string(said, ' ') AS phrase, a, m[3] AS l, m[4] AS r, n, m[1] AS score FROM left_over o JOIN n USING (lang))
SELECT * FROM r WHERE rank <= 2000"""


def _whole(scale: int) -> str:
    """Rows that take part, numbered, with their components as whole numbers."""
    return f"""SELECT row_number() OVER () AS rn, vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM t
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


TOP_K = f"""WITH t AS (SELECT vec_id, label, embedding FROM embeddings), v AS ({_whole(64)}),
p AS (SELECT q.rn, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

HARD_NEGATIVES = f"""WITH t AS (SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM embeddings WHERE label IS NOT NULL), v AS ({_whole(256)}),
p AS (SELECT a.rn, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e) WHERE a.vec_id % 50 = 0),
pos AS (SELECT rn, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS place FROM p WHERE same),
neg AS (SELECT o.*, p.vec_id AS negative_id, p.score AS negative_score, CAST(row_number() OVER (PARTITION BY o.rn, o.place ORDER BY p.score DESC, p.vec_id) AS INTEGER) AS rank
 FROM pos o JOIN p ON p.rn = o.rn AND NOT p.same AND 50 * positive_score <= 100 * p.score AND 100 * p.score <= 95 * positive_score WHERE place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3"""
