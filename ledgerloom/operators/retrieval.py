"""Filtered exact vector retrieval for a whole table of questions.

Questions and vectors are dealt out by company (questions without one: all vectors) into
blocks of about ``BLOCK_BYTES``; each block of questions meets each block of vectors of its
company once, in one task, as matrix products of ``QUERY_SLICE`` questions with a batch of
vectors.  Such a task keeps the best ``k`` per question, so pairs are never emitted; the
candidates meet in one top-k per question.  Neither side passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators.ordered import top_per_key
from ledgerloom.session import materialize

BLOCK_BYTES = 32 << 20
QUERY_SLICE = 512
# Scores that agree so far are equal: a product's last bits depend on its place in a block.
SAME_DIGITS = 10
FILTERS = ("company", "year", "doc_type", "section", "document_id")
HIT_COLUMNS = ("chunk_id", "document_id", "company", "year", "doc_type", "section", "subsection",
               "page_start", "page_end", "text", "token_count", "has_heading", "contains_table", "quality_score")
MIN_TOKENS, MIN_TEXT = 20, 40
# Texts that mean "no filter".
NO_FILTER = ("", "string", "none", "null")


def search_depth(top_k: int) -> int:
    return max(top_k * 4, 40)


def _given(c: Column) -> Column:
    return F.when(~F.lower(T.strip(c)).isin(*NO_FILTER), c)


def normalized_filters(queries: DataFrame) -> DataFrame:
    """Filter columns in stored form; a column that filters nothing becomes null."""
    have = set(queries.columns)

    def c(name, kind="string"):
        return F.col(name) if name in have else F.lit(None).cast(kind)

    forms = {
        "company": F.upper(T.strip(_given(c("company")))),
        "year": F.when(c("year", "int") > 1900, c("year", "int")),
        "doc_type": F.lower(T.strip(_given(c("doc_type")))),
        "section": _given(c("section")), "document_id": _given(c("document_id")),
    }
    return queries.withColumns(forms)


def metadata_filter(vectors: DataFrame, company: str | None = None, year: int | None = None,
                    doc_type: str | None = None, section: str | None = None,
                    document_id: str | None = None, min_tokens: int | None = None) -> DataFrame:
    """AND of the filters given; literals reach the Parquet scan."""
    def given(v):
        return v is not None and v.strip().lower() not in NO_FILTER

    out = vectors
    if given(company):
        out = out.where(F.col("company") == company.strip().upper())
    if year is not None and year > 1900:
        out = out.where(F.col("year") == year)
    if given(doc_type):
        out = out.where(F.col("doc_type") == doc_type.strip().lower())
    if given(section):
        out = out.where(F.col("section") == section)
    if given(document_id):
        out = out.where(F.col("document_id") == document_id)
    if min_tokens is not None and min_tokens > 0:
        out = out.where(F.col("token_count") >= min_tokens)
    return out


def min_text_filter(hits: DataFrame) -> DataFrame:
    return hits.where(F.length(T.strip("text")) >= MIN_TEXT)


def score_threshold(hits: DataFrame, min_score: float) -> DataFrame:
    return hits.where(F.col("score") >= min_score) if min_score > 0 else hits


class _Best:
    """Best ``k`` (score, chunk id) of one query; equal scores keep the smaller ids."""

    __slots__ = ("scores", "ids", "k")

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0), np.empty(0, dtype=str)

    def floor(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        floor = self.floor()
        if len(scores) > self.k:
            floor = max(floor, np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
        take = np.flatnonzero(scores >= floor)
        if len(take):
            both, names = np.concatenate([self.scores, scores[take]]), np.concatenate([self.ids, ids[take]])
            order = np.lexsort((names, -both))[:self.k]
            self.scores, self.ids = both[order], names[order]


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def _score_batches(block: pd.DataFrame, k: int):
    """Function of the vectors' batches: best k rows per query of the block.

    Queries with the same filters share one mask per batch; scores are held for QUERY_SLICE
    queries and one batch of vectors at a time.
    """
    groups = []
    wanted = block[list(FILTERS)].astype(object).where(block[list(FILTERS)].notna(), None)
    for values, index in wanted.groupby(list(FILTERS), dropna=False, sort=False).indices.items():
        matrix = np.array(block["query_vector"].iloc[index].tolist(), dtype=np.float64)
        groups.append(({f: v for f, v in zip(FILTERS, values) if not pd.isna(v)}, index, _unit_rows(matrix)))
    ids = block["query_id"].to_list()
    dim = len(block["query_vector"].iloc[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in ids]
        for batch in batches:
            sized = pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), dim), False)
            batch = batch.filter(sized)
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            v = _unit_rows(flat.astype(np.float64).reshape(-1, dim))
            chunk_ids = np.array(batch.column("chunk_id").to_pylist(), dtype=str)
            for filters, index, matrix in groups:
                rows = np.arange(len(v))
                if filters:
                    mask = np.ones(len(v), dtype=bool)
                    for f, value in filters.items():
                        column = batch.column(f)
                        same = pc.equal(column, pa.scalar(value, type=column.type))
                        mask &= pc.fill_null(same, False).to_numpy(zero_copy_only=False)
                    rows = np.flatnonzero(mask)
                    if not len(rows):
                        continue
                names = chunk_ids[rows]
                for first in range(0, len(index), QUERY_SLICE):
                    scores = np.round(matrix[first:first + QUERY_SLICE] @ v[rows].T, SAME_DIGITS)
                    tops = scores.max(axis=1)
                    for i, q in enumerate(index[first:first + QUERY_SLICE]):
                        if tops[i] >= best[q].floor():
                            best[q].offer(scores[i], names)
        found = [(ids[q], c, s) for q, held in enumerate(best) for c, s in zip(held.ids.tolist(), held.scores.tolist())]
        if found:
            query_ids, names, raw = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids), pa.array(names), pa.array(raw)], ["query_id", "chunk_id", "raw"])

    return run


def _blocked_hits(queries: DataFrame, vectors: DataFrame, top_k: int, block_bytes: int, dim: int, any_open: bool) -> DataFrame:
    """Best rows per query of every meeting of a block of queries with a block of vectors."""
    own = F.concat(F.lit("="), "company")
    sides = vectors.withColumn("_side", F.explode(F.array(own, F.lit("*"))) if any_open else own)
    q = queries.withColumn("_side", F.coalesce(own, F.lit("*")))
    rows = max(1, block_bytes // (8 * max(1, dim) + 256))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("_side").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    # One row per company asked for; written, so that the joins below know its size.
    sizes = materialize(blocks(sides, "_nv").join(blocks(q, "_nq"), "_side"), "block-numbers")

    def dealt(df: DataFrame, key: str, mine: str, others: str) -> DataFrame:
        own_block = F.pmod(F.xxhash64(key), F.col("_n" + mine)).cast("int")
        return (df.join(sizes, "_side").withColumn("_" + mine, own_block)
                .withColumn("_" + others, F.explode(F.sequence(F.lit(0), F.col("_n" + others) - 1))).drop("_nv", "_nq"))

    keys = ["_side", "_v", "_q"]
    id_type = queries.schema["query_id"].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([right.schema.field("query_id"), pa.field("chunk_id", pa.string()), pa.field("raw", pa.float64())])
        found = []
        if left.num_rows and right.num_rows:
            found = list(_score_batches(right.to_pandas(), top_k)(left.to_batches(max_chunksize=2000)))
        return pa.concat_tables([pa.Table.from_batches([b]).cast(schema) for b in found]) if found else schema.empty_table()

    return (dealt(sides, "chunk_id", "v", "q").groupBy(*keys).cogroup(dealt(q, "query_id", "q", "v").groupBy(*keys))
            .applyInArrow(meet, f"query_id {id_type}, chunk_id string, raw double"))


def vector_search(queries: DataFrame, vectors: DataFrame, top_k: int, min_score: float = 0.0,
                  min_tokens: int | None = None, block_bytes: int = BLOCK_BYTES, columns: tuple[str, ...] = HIT_COLUMNS) -> DataFrame:
    """Best ``top_k`` chunks per query by cosine, ties to smaller ids: ``query_id, rank, score`` and the chunk columns.

    ``queries`` has ``query_id``, ``query_vector`` and any of the filter columns;
    ``chunk_id`` is unique in ``vectors``.  A task holds one block of each side and
    ``QUERY_SLICE`` x 2,000 scores.
    """
    q = normalized_filters(queries).select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"),
                                           *FILTERS)
    # Read for their number, for the blocks and for the companies asked for: computed once.
    q = materialize(q, "queries")
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("query_vector")).alias("dim"),
                 F.count_if(F.col("company").isNull()).alias("open")).first()
    if not size["n"]:
        none = vectors.limit(0).select(F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"),
                                       F.lit(1).alias("rank"), F.lit(0.0).alias("score"), *columns)
        return none
    pool = vectors.where(F.col("token_count") >= min_tokens) if min_tokens else vectors
    slim = pool.select("chunk_id", "embedding", *FILTERS)
    found = _blocked_hits(q, slim, top_k, block_bytes, size["dim"], size["open"] > 0)
    ranked = top_per_key(found, ["query_id"], [F.desc("raw"), F.asc("chunk_id")], top_k, "rank")
    # At most top_k narrow rows per query: written once, so that no later step searches again
    # and the join below knows their real size.
    scored = materialize(ranked.select("query_id", "rank", F.round("raw", 4).alias("score"), "chunk_id"), "hits")
    if min_score > 0:
        scored = scored.where(F.col("score") >= min_score)
    payload = vectors.select(*columns)
    if not size["open"]:
        payload = payload.join(q.select("company").distinct(), "company", "left_semi")
    return scored.join(payload, "chunk_id").select("query_id", "rank", "score", *columns)


def relevance_tier(score) -> Column:
    s = T.col(score)
    return (F.when(s >= 0.85, "excellent").when(s >= 0.75, "good").when(s >= 0.60, "fair").otherwise("low"))


def rerank(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Stable order by the score adjusted with metadata signals."""
    keys = keys or ["query_id"]
    adjusted = (F.col("score") + F.when(F.col("has_heading"), 0.02).otherwise(0.0)
                + F.when(F.col("quality_score") > 0.8, 0.01).otherwise(0.0)
                - F.when(F.col("contains_table"), 0.01).otherwise(0.0)
                + F.when(T.truthy("section").isNotNull(), 0.02).otherwise(0.0))
    out = hits.withColumn("rerank_score", F.round(F.least(F.lit(1.0), adjusted), 4))
    w = Window.partitionBy(*keys).orderBy(F.desc("rerank_score"), F.asc("rank"))
    return out.withColumn("rank", F.row_number().over(w))


def deduplicate_hits(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Greedy in rank order: a hit goes when its id or its first 200 characters were kept before.

    A query has at most the search depth of hits, so the fold runs over a short array.
    """
    keys = keys or ["query_id"]
    rest = [c for c in hits.columns if c not in keys]
    row = F.struct(F.col("rank").alias("_rank"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("_prefix"), *rest)
    listed = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(row), lambda a, b: a["_rank"] - b["_rank"]).alias("h"))
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.array().cast("array<string>").alias("prefixes"),
                     F.array().cast("array<int>").alias("ranks"))

    def step(acc, x):
        seen = F.array_contains(acc["ids"], x["chunk_id"]) | F.array_contains(acc["prefixes"], x["_prefix"])
        return F.when(seen, acc).otherwise(F.struct(
            F.concat(acc["ids"], F.array(x["chunk_id"])).alias("ids"),
            F.concat(acc["prefixes"], F.array(x["_prefix"])).alias("prefixes"),
            F.concat(acc["ranks"], F.array(x["_rank"])).alias("ranks")))

    kept = F.aggregate("h", start, step, lambda a: a["ranks"])
    chosen = listed.select(*keys, kept.alias("k"), "h").select(
        *keys, F.inline(F.filter("h", lambda x: F.array_contains(F.col("k"), x["_rank"]))))
    return chosen.select(*hits.columns)


def renumber(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["query_id"]
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))


def assemble_context(hits: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Documents in order of first appearance, pages ascending inside: ``position``."""
    keys = keys or ["query_id"]
    doc = F.coalesce(T.truthy("document_id"), F.lit("unknown"))
    first = F.min("rank").over(Window.partitionBy(*keys, doc))
    order = Window.partitionBy(*keys).orderBy("_first", F.coalesce("page_start", F.lit(0)), "rank")
    return (hits.withColumn("_first", first).withColumn("position", F.row_number().over(order)).drop("_first"))


def with_text(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hits of ``retrieve`` without text, with the text of their chunk."""
    return hits.join(vectors.select("chunk_id", "text"), "chunk_id").select(*hits.columns, "text")


def retrieve(queries: DataFrame, vectors: DataFrame, top_k: int = 10, min_score: float = 0.0,
             do_rerank: bool = True, do_deduplicate: bool = True, texts: bool = True) -> DataFrame:
    """Search, drop short texts, re-rank, de-duplicate, trim and put in reading order.

    A chunk says once whether its text is long enough and has a digest of its opening; the candidates
    carry these, and only the kept hits get their text, or none do (``texts=False``).
    """
    opening = F.md5(F.substring(F.coalesce("text", F.lit("")), 1, 200))
    slim = vectors.withColumns({"_long": F.length(T.strip("text")) >= MIN_TEXT, "text": opening})
    found = vector_search(queries, slim, search_depth(top_k), min_score, MIN_TOKENS, columns=(*HIT_COLUMNS, "_long"))
    hits = renumber(found.where("_long").drop("_long"))
    if do_rerank:
        hits = rerank(hits)
    if do_deduplicate:
        hits = deduplicate_hits(hits)
    hits = assemble_context(renumber(hits).where(F.col("rank") <= top_k)).withColumn("relevance", relevance_tier("score"))
    columns = hits.columns
    hits = hits.drop("text")
    return with_text(hits, vectors).select(*columns) if texts else hits


def filters_applied(queries: DataFrame) -> Column:
    """Echo of the filters a query was given."""
    pairs = [F.when(T.truthy(F.col(c).cast("string")).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string")))
             for c in FILTERS if c in queries.columns]
    return F.concat_ws(";", *pairs)


def multi_query_retrieve(plans: DataFrame, vectors: DataFrame, embed, max_queries: int | None = None,
                         top_k: int = 5, texts: bool = True) -> DataFrame:
    """The ``top_k`` hits of each planned query (the first ``max_queries`` or all) of each request, first occurrence of a chunk wins.

    Requests ask the same queries of a company, so each of these is searched once.
    """
    q = plans.select("request_id", F.try_element_at("companies", F.lit(1)).alias("company"),
                     F.posexplode("retrieval_queries" if max_queries is None else F.slice("retrieval_queries", 1, max_queries)).alias("query_no", "query"))
    q = q.withColumn("asked", F.md5(F.to_json(F.struct("company", "query"))))
    asked = q.select(F.col("asked").alias("query_id"), "company", "query").distinct()
    asked = asked.select("query_id", "company", embed(F.col("query")).alias("query_vector")).where(F.size("query_vector") > 0)
    # Written, so that the search is done once and the join below knows its size.
    found = materialize(retrieve(asked, vectors, top_k, texts=False), "answers").withColumnRenamed("query_id", "asked")
    hits = q.select("request_id", "query_no", "asked").join(found, "asked").drop("asked")
    first = Window.partitionBy("request_id", "chunk_id").orderBy("query_no", "position")
    order = Window.partitionBy("request_id").orderBy("query_no", "position")
    # One shuffle serves both windows.
    hits = (hits.repartition("request_id").withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
            .withColumn("pos", F.row_number().over(order)))
    return with_text(hits, vectors) if texts else hits
