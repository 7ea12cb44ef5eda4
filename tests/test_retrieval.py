from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import context as X
from ledgerloom.operators import embedding as E
from ledgerloom.operators import retrieval as R

SCHEMA = ("chunk_id string, document_id string, company string, year int, doc_type string, section string, subsection string, page_start int, "
          "page_end int, text string, token_count int, has_heading boolean, contains_table boolean, quality_score double, embedding array<float>")


@pytest.fixture(scope="module")
def store(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        v = rng.integers(-3, 4, 8).astype(float) if i % 7 else np.zeros(8)
        rows.append((f"c{i:03d}", f"d{i // 8}", f"CO{i % 3}", None if i % 11 == 0 else 2020 + i % 3, "annual_report" if i % 2 else "news",
                     f"S{i % 4}", None, i % 5, i % 5, f"text of chunk number {i} with some words in it", 5 + i % 40, i % 3 == 0, i % 5 == 0, 0.5, v.tolist()))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute(rows, q, k, keep):
    q = np.array(q) / np.linalg.norm(q)
    scored = []
    for r in rows:
        v = np.array(r[-1], dtype=float)
        n = np.linalg.norm(v)
        if keep(r):
            scored.append((-float(q @ (v / n if n else v)), r[0]))
    return [(c, round(-s, 4) + 0.0) for s, c in sorted(scored, key=lambda x: (round(x[0], 9), x[1]))[:k]]


@pytest.mark.parametrize("block_bytes", [R.BLOCK_BYTES, 700])
def test_search_equals_brute_force(spark, store, block_bytes):
    rows, vectors = store
    rng = np.random.default_rng(9)
    asked = [("all", rng.integers(-3, 4, 8), None, None, None, lambda r: True), ("co", rng.integers(-3, 4, 8), " co1", None, "string", lambda r: r[2] == "CO1"),
             ("year", rng.integers(-3, 4, 8), "None", 2021, None, lambda r: r[3] == 2021), ("two", rng.integers(-3, 4, 8), "CO2", 1900, "NEWS ", lambda r: r[2] == "CO2" and r[4] == "news"),
             ("none", rng.integers(-3, 4, 8), "CO9", None, None, lambda r: False)]
    q = spark.createDataFrame([(a, [float(x) for x in v], c, y, d) for a, v, c, y, d, _ in asked],
                              "query_id string, query_vector array<double>, company string, year int, doc_type string")
    got = {}
    for r in R.vector_search(q, vectors, 12, min_tokens=20, block_bytes=block_bytes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score + 0.0))
    for a, v, _, _, _, keep in asked:
        assert got.get(a, []) == brute(rows, v, 12, lambda r, k=keep: k(r) and r[10] >= 20), a


def test_threshold_and_empty(spark, store):
    _, vectors = store
    q = spark.createDataFrame([("a", [1.0] * 8)], "query_id string, query_vector array<double>")
    assert all(r.score >= 0.6 for r in R.vector_search(q, vectors, 20, 0.6).collect())
    assert R.vector_search(q.limit(0), vectors, 20).count() == 0


def hits(spark, rows):
    names = "chunk_id string, document_id string, page_start int, text string, score double, has_heading boolean, quality_score double, contains_table boolean, section string"
    return spark.createDataFrame([("q", i + 1, *r) for i, r in enumerate(rows)], "query_id string, rank int, " + names)


def test_rerank(spark):
    df = hits(spark, [("no_heading", "d", 1, "t", 0.80, False, 0.7, False, None), ("with_heading", "d", 1, "t", 0.78, True, 0.9, False, "Risk"),
                      ("table", "d", 1, "t", 0.82, False, 0.6, True, None)])
    got = [(r.chunk_id, r.rerank_score) for r in R.rerank(df).orderBy("rank").collect()]
    assert got == [("with_heading", 0.83), ("table", 0.81), ("no_heading", 0.8)]


def test_deduplicate_is_greedy(spark):
    same = "x" * 200
    df = hits(spark, [("a", "d", 1, "Revenue up.", .9, False, 0., False, None), ("a", "d", 1, "other", .85, False, 0., False, None),
                      ("b", "d", 1, "Revenue up.", .8, False, 0., False, None), ("c", "d", 1, same + "1", .7, False, 0., False, None),
                      ("e", "d", 1, same + "2", .6, False, 0., False, None), ("b", "d", 1, "kept, since b was dropped", .5, False, 0., False, None)])
    assert [r["rank"] for r in R.deduplicate_hits(df).orderBy("rank").collect()] == [1, 4, 6]


def test_assemble(spark):
    df = hits(spark, [("c", "doc1", 50, "t", .8, False, 0., False, None), ("a", "doc1", 10, "t", .9, False, 0., False, None),
                      ("d", "doc2", 5, "t", .7, False, 0., False, None), ("b", "doc1", 30, "t", .85, False, 0., False, None), ("z", "doc1", None, "t", .1, False, 0., False, None)])
    assert [r.chunk_id for r in R.assemble_context(df).orderBy("position").collect()] == ["z", "a", "b", "c", "d"]


@pytest.mark.parametrize("question, kind", [
    ("Compare TCS and INFY", "comparative"), ("TCS vs. Infosys revenue", "comparative"), ("Give a brief overview", "summarization"),
    ("Summarize the risks", "summarization"), ("Why did margins fall?", "analytical"), ("What is the revenue?", "factual")])
def test_question_classes(spark, question, kind):
    df = spark.createDataFrame([(question,)], "q string")
    assert df.select(X.classify_question("q").alias("k")).first().k == kind


def test_expand(spark):
    df = spark.createDataFrame([("AI and R&D, then AI again",), ("ai stays; M&A",)], "q string")
    assert [r.e for r in df.select(X.expand_query("q").alias("e")).collect()] == [
        "Artificial Intelligence AI Machine Learning Generative AI and research development R&D innovation, then AI again", "ai stays; mergers acquisitions M&A"]


def context_hits(spark, rows):
    return spark.createDataFrame(
        [("q", i + 1, *r) for i, r in enumerate(rows)],
        "query_id string, position int, chunk_id string, document_id string, company string, doc_type string, year int, section string, page_start int, page_end int, text string, score double")


def test_context_budget_and_numbers(spark):
    rows = [(f"c{i}", f"d{i:02d}", "TCS", None, None, None, 1, 1, "w" * 10000, 0.9) for i in range(20)]
    blocks = X.context_blocks(context_hits(spark, rows), 3000)
    assert X.build_context(blocks).first().chunks_used == 1
    rows = [("c1", "b", "TCS", "annual_report", 2025, "Risk", 3, 5, "  second  ", 0.8), ("c0", "a", None, None, None, None, None, None, "first", 0.9),
            ("c1", "b", "TCS", None, None, None, 3, 3, "dup", 0.7), ("c2", "b", "TCS", None, 0, None, 2, 2, " ", 0.7), ("c3", "c", "TCS", None, None, None, 4, 4, "x" * 400, 0.5),
            ("c4", "d", None, None, None, None, 4, 4, "tiny", 0.5)]
    blocks = X.context_blocks(context_hits(spark, rows), 60).orderBy("ref").collect()
    assert [(b.ref, b.chunk_id, b.source) for b in blocks] == [(1, "c0", "Unknown source"), (3, "c1", "TCS, annual_report, 2025, Risk, Pages 3–5")]
    text = X.build_context(X.context_blocks(context_hits(spark, rows), 60)).first()
    assert text.context_text == "[1] first\n\n[3] second"


def test_confidence(spark):
    rows = [(f"c{i}", f"d{i}", None, None, None, None, 1, 1, "text", s) for i, s in enumerate([.95, .9, .88, .85, .82])]
    df = context_hits(spark, rows)
    r = X.confidence(df, X.build_context(X.context_blocks(df)), 10).first()
    assert (r.confidence, r.tier, r.chunks_used, r.evidence_sufficient) == (0.78, "medium", 5, True)
    none = spark.range(1).select(*[c.alias(n) for n, c in X.confidence_columns(
        F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0), F.lit(10)).items()]).first()
    assert (none.confidence, none.tier) == (0.0, "insufficient")
    weak = spark.range(1).select(X.confidence_columns(F.lit(.2), F.lit(.3), F.lit(2), F.lit(10))["confidence"].alias("c")).first()
    assert weak.c == 0.22


def test_answer_rows(spark):
    q = spark.createDataFrame([("q", "How?", "factual"), ("r", "None?", "factual")], "query_id string, question string, question_type string")
    df = context_hits(spark, [("c", "d", None, None, None, None, 1, 1, "evidence", 0.9)])
    got = {r.query_id: r for r in X.answer_record(q, df, X.context_blocks(df), 10).collect()}
    assert (got["q"].route, got["q"].chunks_used, got["q"].answer) == ("answer", 1, None)
    assert (got["r"].route, got["r"].tier, got["r"].answer) == ("insufficient", "insufficient", X.INSUFFICIENT)
    prompt = X.prompt_text(q.withColumn("context_text", F.lit("[1] evidence")), X.templates(spark)).where("query_id = 'q'").first().prompt
    assert "How?" in prompt and "[1] evidence" in prompt and "{" not in prompt


CACHE = "content_hash string, chunk_id string, embedding array<float>, embedding_model string, embedding_version int, created_at timestamp"


def test_cache(spark):
    import datetime as dt
    t = dt.datetime(2024, 1, 1)
    first = spark.createDataFrame([("h", "c1", [1.0], "m", 1, t), ("h", "c1", [2.0], "n", 1, t)], CACHE)
    again = spark.createDataFrame([("h", "c9", [3.0], "m", 1, t), ("h", "c9", [4.0], "m", 2, t)], CACHE)
    got = {(r.embedding_model, r.embedding_version): r.embedding[0] for r in E.cache_put(first, again).collect()}
    assert got == {("m", 1): 3.0, ("n", 1): 2.0, ("m", 2): 4.0}
    chunks = spark.createDataFrame([("h",), ("i",)], "content_hash string")
    hit = {r.content_hash: r.cached_embedding for r in E.cache_lookup(chunks, first, "m", 1).collect()}
    assert hit == {"h": [1.0], "i": None}
    assert E.cache_stats(first).first().models == "m,n"


def test_embed_chunks_copies_and_failures(spark):
    import hashlib
    import datetime as dt
    cached = hashlib.sha256(b"known text").hexdigest()
    cache = spark.createDataFrame([(cached, "c", [0.5, 0.5], "hashing-64", 1, dt.datetime(2024, 1, 1))], CACHE)
    chunks = spark.createDataFrame([("a", "known text"), ("b", "new words"), ("c", "new words"), ("d", "--- ...")], "chunk_id string, text string")
    got = {r.chunk_id: r for r in E.embed_chunks(chunks, cache).collect()}
    assert {k: r.embedding_status for k, r in got.items()} == {"a": "cached", "b": "embedded", "c": "embedded", "d": "failed"}
    assert got["b"].embedding == got["c"].embedding and len(got["b"].embedding) == 64
    assert got["a"].embedding == [0.5, 0.5] and got["d"].embedding == []


def test_upsert_and_delete(spark):
    schema = "chunk_id string, document_id string, embedding array<float>, pos int"
    old = spark.createDataFrame([("a", "d1", [1.0], 0), ("b", "d2", [1.0], 0)], schema)
    new = spark.createDataFrame([("a", "d3", [2.0], 1), ("a", "d4", [3.0], 2), ("", "d", [1.0], 3), ("c", "d5", [], 4), ("e", "d2", [9.0], 5)], schema)
    once = E.vector_upsert(old, new, "pos")
    assert sorted((r.chunk_id, r.document_id) for r in once.collect()) == [("a", "d4"), ("b", "d2"), ("e", "d2")]
    assert sorted(E.vector_upsert(once, new, "pos").collect()) == sorted(once.collect())
    assert E.upsert_counts(new).first().asDict() == {"uploaded": 3, "skipped": 2, "failed": 0}
    left = E.vector_delete_by_document(once, spark.createDataFrame([("d2",)], "document_id string"))
    assert [r.chunk_id for r in left.collect()] == ["a"]


def test_candidates_carry_no_text_and_equal_queries_are_searched_once(spark, store, monkeypatch):
    _, vectors = store
    vector = F.array(*[F.lit(float(x)) for x in (1, -2, 3, 0, 1, 1, -1, 2)])
    plans = spark.createDataFrame([(f"R{i}", ["co1"], ["a", "b"]) for i in range(6)] + [("R9", [], ["a"])],
                                  "request_id string, companies array<string>, retrieval_queries array<string>")
    asked, searched = [], R.vector_search

    def counted(queries, vectors, *args, **kwargs):
        asked.append(queries.count())
        found = searched(queries, vectors, *args, **kwargs)
        assert found.select(F.max(F.length("text"))).first()[0] == 32
        return found

    monkeypatch.setattr(R, "vector_search", counted)
    got = R.multi_query_retrieve(plans, vectors, lambda c: F.when(c.isNotNull(), vector), top_k=4).collect()
    assert asked == [3]
    per = {r: [(x.pos, x.chunk_id, x.score) for x in sorted(got, key=lambda x: x.pos) if x.request_id == r] for r in ("R0", "R5", "R9")}
    assert per["R0"] == per["R5"] and [p for p, _, _ in per["R0"]] == [1, 2, 3, 4] and len(per["R9"]) == 4
    assert all(x.text == f"text of chunk number {int(x.chunk_id[1:])} with some words in it" and x.query_no == 0 for x in got)
