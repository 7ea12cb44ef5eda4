"""From landed files to vectors: extract, clean, chunk, embed, upsert, register."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.text import truthy
from ledgerloom.functions.vectors import EMBED_MODEL, embed_fn
from ledgerloom.operators import cleaning, chunking, embedding
from ledgerloom.session import materialize
from ledgerloom.sources import documents as D

VECTOR_COLUMNS = ("chunk_id", "document_id", "company", "year", "doc_type", "section", "subsection", "page_start", "page_end",
                  "text", "token_count", "has_heading", "contains_table", "quality_score", "embedding", "embedding_model", "content_hash")


@dataclass
class Ingested:
    pages: DataFrame
    chunks: DataFrame
    embedded: DataFrame
    outcomes: DataFrame

    def stats(self) -> DataFrame:
        """Documents embedded, skipped and failed, and the chunks of the embedded ones."""
        o = self.outcomes
        return o.agg(
            F.count_if(F.col("outcome") == "embedded").alias("docs_embedded"), F.count_if(F.col("outcome") == "skipped").alias("docs_skipped"),
            F.count_if(F.col("outcome") == "failed").alias("docs_failed"),
            F.coalesce(F.sum(F.when(F.col("outcome") == "embedded", F.col("chunks"))), F.lit(0)).alias("total_chunks"),
            F.coalesce(F.sum(F.when(F.col("outcome") == "embedded", F.col("cached"))), F.lit(0)).alias("total_cached"))

    def progress(self) -> DataFrame:
        """One row per document and finished stage."""
        pages = self.pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        chunks = self.chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        done = self.outcomes.select("document_id", F.col("outcome").alias("stage"), F.coalesce("chunks", F.lit(0)).alias("n"))
        return (pages.select("document_id", F.lit("extract").alias("stage"), "n")
                .unionByName(chunks.select("document_id", F.lit("chunk").alias("stage"), "n")).unionByName(done))


def extract_pages(scanned: DataFrame, pdf_pages: DataFrame | None = None) -> DataFrame:
    """Pages of scanned files by type; page texts of PDFs come as a landed table."""
    ok = scanned.where("success")
    html = D.html_to_pages(ok.where("file_type = 'html'").withColumn("html", F.col("content").cast("string")), ["document_id"])
    json = ok.where("file_type = 'json'").select(
        "document_id", F.lit(1).alias("page"), D.json_statement_to_text(F.col("content").cast("string")).alias("text"))
    out = html.unionByName(json.withColumn("char_count", F.length("text")))
    if pdf_pages is not None:
        pdf = pdf_pages.join(ok.where("file_type = 'pdf'").select("document_id"), "document_id", "left_semi")
        out = out.unionByName(pdf.select("document_id", "page", "text", F.length("text").alias("char_count")))
    return out


def embed_documents_job(registry: DataFrame, files: DataFrame, cache: DataFrame, embed=embed_fn, model: str = EMBED_MODEL,
                        version: int = 1, pdf_pages: DataFrame | None = None) -> Ingested:
    """Documents that are not embedded yet and have a file go through all steps.

    ``registry``: document_id, ticker, year, doc_type, file_path, processing_status;
    ``files``: path, content.  Stage tables are written, so that later steps do not
    repeat earlier ones and a lost executor only re-reads files.
    """
    todo = registry.where((F.coalesce("processing_status", F.lit("")) != "embedded") & truthy("file_path").isNotNull())
    landed = files.join(todo.select(F.col("file_path").alias("path"), "document_id"), "path")
    scanned = D.scan_documents(landed)
    pages = materialize(cleaning.clean_document(extract_pages(scanned, pdf_pages)).select("document_id", "page", "clean_text"), "pages")
    chunks = chunking.chunk_document(pages)
    meta = registry.select("document_id", F.col("ticker").alias("company"), "year", "doc_type")
    chunks = materialize(chunks.join(meta, "document_id"), "chunks")
    embedded = materialize(embedding.embed_chunks(chunks, cache, model, version, embed), "embedded")
    per_doc = embedded.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("embedding_status") == "cached").alias("cached"),
        F.count_if(F.col("embedding_status") == "failed").alias("failed_chunks"))
    done = registry.select("document_id", "processing_status").join(per_doc, "document_id", "left")
    outcome = (F.when(F.col("processing_status") == "embedded", "skipped")
               .when(F.col("chunks").isNotNull() & (F.col("failed_chunks") == 0), "embedded").otherwise("failed"))
    outcomes = done.select("document_id", outcome.alias("outcome"), "chunks", "cached", "failed_chunks")
    return Ingested(pages, chunks, embedded, outcomes)


def apply_outcomes(registry: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Registry with the new status of embedded documents."""
    good = outcomes.where("outcome = 'embedded'").select("document_id", F.lit("embedded").alias("_s"))
    return (registry.join(good, "document_id", "left")
            .withColumn("processing_status", F.coalesce("_s", "processing_status")).drop("_s").select(*registry.columns))
