"""Maintenance of the embedding cache and of the vector table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import col, truthy
from ledgerloom.functions.vectors import EMBED_MODEL, embed_fn
from ledgerloom.operators.ordered import last_per_key
from ledgerloom.sources.snapshots import SnapshotTable

CACHE_KEY = ["content_hash", "embedding_model", "embedding_version"]


def hash_text(c) -> Column:
    return F.sha2(col(c), 256)


def _of_model(cache: DataFrame, model: str, version: int) -> DataFrame:
    return cache.where((F.col("embedding_model") == model) & (F.col("embedding_version") == version))


def cache_lookup(chunks: DataFrame, cache: DataFrame, model: str = EMBED_MODEL, version: int = 1) -> DataFrame:
    """Adds ``cached_embedding`` (null on a miss); input has ``content_hash``."""
    known = _of_model(cache, model, version).select("content_hash", F.col("embedding").alias("cached_embedding"))
    return chunks.join(known, "content_hash", "left")


def cache_put(cache: DataFrame, rows: DataFrame, order: str = "created_at") -> DataFrame:
    """New snapshot of the cache: insert or replace on hash, model and version."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return last_per_key(both, CACHE_KEY, [F.col("_new"), F.col(order)]).drop("_new").select(*cache.columns)


def store_cache(table: SnapshotTable, rows: DataFrame, order: str = "created_at") -> int:
    """Put rows into a stored cache, of which only the buckets of their keys are rewritten; gives the new version."""
    return table.upsert(rows, lambda cache, new: cache_put(cache, new, order))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("total_entries"),
                     F.array_join(F.array_sort(F.collect_set("embedding_model")), ",").alias("models"))


def embed_chunks(chunks: DataFrame, cache: DataFrame, model: str = EMBED_MODEL, version: int = 1,
                 embed=embed_fn) -> DataFrame:
    """Vectors for all chunks: from the cache, else computed once per distinct text.

    Copies of a text meet in an aggregate before the vectoriser, so a text that makes
    up a large share of the rows is still embedded once.  A text without a vector keeps
    its row with an empty one and counts as failed.
    """
    keyed = chunks.withColumn("content_hash", hash_text("text"))
    texts = keyed.groupBy("content_hash").agg(F.first("text").alias("text"))
    looked = cache_lookup(texts, cache, model, version)
    miss = F.col("cached_embedding").isNull()
    vectors = looked.select(
        "content_hash", "cached_embedding", embed(F.when(miss, F.col("text"))).alias("fresh"))
    empty = F.array().cast("array<float>")
    vectors = vectors.select(
        "content_hash", F.coalesce("cached_embedding", "fresh", empty).alias("embedding"),
        F.when(F.col("cached_embedding").isNotNull(), "cached")
        .when(F.size(F.coalesce("fresh", empty)) > 0, "embedded").otherwise("failed").alias("embedding_status"))
    # A null text has no hash; it is a text like any other here.
    vectors = vectors.withColumnRenamed("content_hash", "_hash")
    return (keyed.join(vectors, F.col("content_hash").eqNullSafe(F.col("_hash"))).drop("_hash")
            .withColumn("embedding_model", F.lit(model)).withColumn("embedding_version", F.lit(version))
            .withColumn("embedding_dim", F.size("embedding")).withColumn("embedded_at", F.current_timestamp()))


def embed_counts(embedded: DataFrame, keys: list[str]) -> DataFrame:
    return embedded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("embedding_status") == s).alias(s) for s in ("embedded", "cached", "failed")])


def vector_upsert(vectors: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """New snapshot of the vector table; rows without id or vector are skipped, the last row of an id wins."""
    usable = rows.where(truthy("chunk_id").isNotNull() & (F.size("embedding") > 0))
    fresh = last_per_key(usable, ["chunk_id"], [F.col(order)]).select(*vectors.columns)
    return vectors.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh)


def store_vectors(table: SnapshotTable, rows: DataFrame, order: str, source: str | None = None, batch: int = 0) -> int:
    """Upsert into a stored vector table, of which only the buckets of the rows' ids are rewritten; gives the new version."""
    usable = rows.where(truthy("chunk_id").isNotNull())
    return table.upsert(usable, lambda old, new: vector_upsert(old, new, order), source, batch)


def upsert_counts(rows: DataFrame) -> DataFrame:
    usable = truthy("chunk_id").isNotNull() & (F.coalesce(F.size("embedding"), F.lit(0)) > 0)
    return rows.agg(F.count_if(usable).alias("uploaded"), F.count_if(~usable).alias("skipped"),
                    F.lit(0).cast("long").alias("failed"))


def vector_delete_by_document(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    return vectors.join(documents.select("document_id").distinct(), "document_id", "left_anti")


def collection_info(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count(F.lit(1)).alias("points_count"), F.max(F.size("embedding")).alias("vector_size"),
                       F.lit("Cosine").alias("distance"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Partitioned so that company and year filters prune files."""
    vectors.write.mode("errorifexists").partitionBy("company", "year").parquet(path)
