"""The document registry: upserts, listings and ingestion summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.text import strip, truthy
from ledgerloom.sources.snapshots import SnapshotTable

REGISTRY_COLUMNS = ("document_id", "ticker", "company_name", "doc_type", "title", "year", "quarter", "file_path",
                    "file_size", "source", "source_url", "checksum_sha256", "processing_status", "download_date", "updated_at")
_KEPT = ("ticker", "company_name", "doc_type", "title", "year", "quarter", "source", "source_url")


def registry_upsert(registry: DataFrame, updates: DataFrame, order: str = "pos") -> DataFrame:
    """New snapshot of the registry after a batch of updates.

    A new document takes its first row of the batch.  Path, size and checksum keep the
    last value that is not empty; status and time come from the last row; the rest never
    changes.  Several updates of one document are folded by aggregation, so a document
    that is updated very often is no hot task.
    """
    def last_given(name, given):
        return F.max_by(F.when(given, F.col(name)), F.when(given, F.col(order))).alias(f"_{name}")

    folded = updates.groupBy("document_id").agg(
        F.min_by(F.struct(*_KEPT), order).alias("_first"), F.min_by("updated_at", order).alias("_created"),
        last_given("file_path", truthy("file_path").isNotNull()), last_given("file_size", F.col("file_size") != 0),
        last_given("checksum_sha256", truthy("checksum_sha256").isNotNull()),
        F.max_by("processing_status", order).alias("_processing_status"), F.max_by("updated_at", order).alias("_updated_at"))
    old = registry.withColumn("_old", F.lit(True))
    j = old.join(folded, "document_id", "full_outer")
    was, hit = F.col("_old").isNotNull(), F.col("_processing_status").isNotNull()
    out = {c: F.when(was, F.col(c)).otherwise(F.upper(f"_first.{c}") if c == "ticker" else F.col(f"_first.{c}")) for c in _KEPT}
    out.update({c: F.coalesce(f"_{c}", c) for c in ("file_path", "file_size", "checksum_sha256")})
    out.update({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("processing_status", "updated_at")})
    out["download_date"] = F.when(was, F.col("download_date")).otherwise(F.col("_created"))
    return j.select("document_id", *[out[c].alias(c) for c in REGISTRY_COLUMNS[1:]])


def store_updates(table: SnapshotTable, updates: DataFrame, order: str = "pos") -> int:
    """Fold updates into a stored registry, of which only the buckets of their documents are rewritten; gives the new version."""
    return table.upsert(updates, lambda old, new: registry_upsert(old, new, order))


def list_documents(registry: DataFrame, ticker: str | None = None, doc_type: str | None = None,
                   year: int | None = None) -> DataFrame:
    """Documents with the name of their company and the number listed with them.

    Without a ticker all companies are listed.  The company name is that of the first
    row in listing order (year descending, type ascending), else the ticker.
    """
    rows = registry
    if ticker:
        rows = rows.where(F.col("ticker") == ticker.strip().upper())
    if doc_type:
        rows = rows.where(F.col("doc_type") == doc_type)
    if year:
        rows = rows.where(F.col("year") == year)
    first = F.struct(-F.coalesce("year", F.lit(-1)), F.col("doc_type"), F.col("document_id"))
    heads = rows.groupBy("ticker").agg(F.min_by(F.struct("company_name"), first).alias("_h"), F.count(F.lit(1)).alias("total_documents"))
    heads = heads.select("ticker", F.coalesce(truthy("_h.company_name"), "ticker").alias("company"), "total_documents")
    return rows.join(heads, "ticker")


def get_document(registry: DataFrame, document_id: str) -> DataFrame:
    return registry.where(F.col("document_id") == document_id)


def registry_exists(candidates: DataFrame, registry: DataFrame, files: DataFrame, exists: bool = True) -> DataFrame:
    """Candidates already registered with a non-empty file, or those that are not."""
    there = (registry.where(truthy("file_path").isNotNull())
             .join(files.where(F.col("length") > 0).select(F.col("path").alias("file_path")), "file_path", "left_semi"))
    return candidates.join(there.select("document_id"), "document_id", "left_semi" if exists else "left_anti")


def collect_results(candidates: DataFrame, existing: DataFrame, source: str) -> DataFrame:
    """Per ticker: how many documents of a source are new, known or failed.

    ``candidates`` has ticker, document_id and ``ok`` (payload landed and valid).
    """
    flagged = candidates.join(existing.select("document_id", F.lit(True).alias("_known")).distinct(), "document_id", "left")
    known = F.col("_known").isNotNull()
    return flagged.groupBy(F.upper(strip("ticker")).alias("ticker")).agg(
        F.count_if(~known & F.col("ok")).alias("new"), F.count_if(known).alias("existing"),
        F.count_if(~known & ~F.col("ok")).alias("failed")).withColumn("source", F.lit(source))


def merge_ingestion(results: list[DataFrame]) -> DataFrame:
    """Sums over the sources of a ticker; sources in the order given."""
    union = None
    for i, r in enumerate(results):
        r = r.withColumn("_at", F.lit(i))
        union = r if union is None else union.unionByName(r)
    return union.groupBy("ticker").agg(
        F.sum("new").alias("new_documents"), F.sum("existing").alias("existing_documents"), F.sum("failed").alias("failed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "source"))), lambda x: x["source"]), ",").alias("sources"))


def documents_by_type(registry: DataFrame) -> DataFrame:
    return registry.groupBy("ticker", "doc_type").agg(F.count(F.lit(1)).alias("documents"))
