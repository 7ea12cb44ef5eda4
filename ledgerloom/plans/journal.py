"""Ingestion that goes on where it stopped: a journal says which stage of which document is finished.

A document is known by its id and the hash of its content.  Each stage takes up the documents that the
journal does not have for it, reads what the stage before has written for them, writes its own rows below a
folder of the run, and then appends one journal row per document.  Rows whose run is not in the journal
belong to a run that failed and are never read.  So a restart repeats no finished stage of any document,
and a document whose content changes goes through all stages again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.text import truthy
from ledgerloom.functions.vectors import EMBED_MODEL, embed_fn
from ledgerloom.operators import chunking, cleaning, embedding
from ledgerloom.plans.ingestion import VECTOR_COLUMNS, extract_pages
from ledgerloom.session import materialize, release
from ledgerloom.sources import documents as D
from ledgerloom.sources.snapshots import SnapshotTable

STAGES = ("extract", "chunk", "embed", "upsert")
DOCUMENT = ["document_id", "content_hash"]
_ENTRY = "document_id string, content_hash string, n long, stage string, run string, finished_at timestamp"


class StageJournal:
    """Finished stages and their rows below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def entries(self) -> DataFrame:
        """document_id, content_hash, n (rows), stage, run, finished_at."""
        if not self._exists("journal"):
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).option("recursiveFileLookup", "true").parquet(f"{self.path}/journal")

    def done(self, stage: str) -> DataFrame:
        """One run for each document that has finished the stage."""
        return self.entries().where(F.col("stage") == stage).groupBy(*DOCUMENT).agg(F.min("run").alias("run"))

    def missing(self, documents: DataFrame, stage: str) -> DataFrame:
        return documents.join(self.done(stage), DOCUMENT, "left_anti")

    def rows(self, stage: str, documents: DataFrame, schema) -> DataFrame:
        """What a stage has written for the documents."""
        if not self._exists(f"rows/{stage}"):
            return self.spark.createDataFrame([], schema)
        wanted = self.done(stage).join(documents.select(*DOCUMENT), DOCUMENT, "left_semi")
        return self.spark.read.parquet(f"{self.path}/rows/{stage}").join(wanted, [*DOCUMENT, "run"], "left_semi").drop("run")

    def write(self, stage: str, rows: DataFrame, run: str) -> DataFrame:
        at = f"{self.path}/rows/{stage}/run={run}"
        rows.write.parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def finish(self, stage: str, counts: DataFrame, run: str) -> None:
        """Append an entry for each document of ``counts`` (document_id, content_hash, n)."""
        entries = counts.select(*DOCUMENT, F.col("n").cast("long").alias("n"), F.lit(stage).alias("stage"), F.lit(run).alias("run"), F.current_timestamp().alias("finished_at"))
        entries.write.parquet(f"{self.path}/journal/{stage}/{run}")

    def progress(self) -> DataFrame:
        """The first time a document finished a stage, in the order of stages: document_id, content_hash, stage, position, n, finished_at."""
        first = self.entries().groupBy(*DOCUMENT, "stage").agg(F.min_by(F.struct("n", "finished_at"), F.struct("finished_at", "run")).alias("e"))
        position = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
        return first.select(*DOCUMENT, "stage", position.alias("position"), "e.n", "e.finished_at")


def _counted(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents with the number of their rows, none included."""
    return documents.select(*DOCUMENT).join(rows.groupBy(*DOCUMENT).agg(F.count(F.lit(1)).alias("n")), DOCUMENT, "left").fillna(0, ["n"])


def resume_documents_job(registry: DataFrame, files: DataFrame, cache: SnapshotTable, vectors: SnapshotTable, journal: StageJournal, embed=embed_fn,
                         model: str = EMBED_MODEL, version: int = 1, pdf_pages: DataFrame | None = None) -> DataFrame:
    """document_id, outcome: files of documents that are not embedded yet go through the stages that they have not finished.

    ``registry`` and ``files`` as for ``embed_documents_job``.  Fresh vectors are put into the cache and the chunks
    of a document take the place of its earlier ones in ``vectors``, a table with the key document_id.  A document
    is ``embedded`` once all its chunks have vectors and are in the table, ``skipped`` if it was embedded before, else ``failed``.
    """
    run = uuid.uuid4().hex
    todo = registry.where((F.coalesce("processing_status", F.lit("")) != "embedded") & truthy("file_path").isNotNull())
    landed = files.join(todo.select(F.col("file_path").alias("path"), "document_id"), "path").withColumn("content_hash", F.sha2(F.coalesce("content", F.lit(b"")), 256))
    documents = materialize(landed.select(*DOCUMENT).distinct(), "documents")

    wanted = journal.missing(documents, "extract")
    scanned = D.scan_documents(landed.join(wanted, DOCUMENT, "left_semi"))
    pages = cleaning.clean_document(extract_pages(scanned, pdf_pages)).select("document_id", "page", "clean_text").join(wanted, "document_id")
    pages = journal.write("extract", pages, run)
    journal.finish("extract", _counted(wanted, pages), run)

    wanted = journal.missing(documents, "chunk")
    meta = registry.select("document_id", F.col("ticker").alias("company"), "year", "doc_type")
    given = journal.rows("extract", wanted, pages.schema)
    chunks = chunking.chunk_document(given.drop("content_hash")).join(meta, "document_id").join(wanted, "document_id")
    chunks = journal.write("chunk", chunks, run)
    journal.finish("chunk", _counted(wanted, chunks), run)

    wanted = journal.missing(documents, "embed")
    given = journal.rows("chunk", wanted, chunks.schema)
    keyed = embedding.embed_chunks(given.drop("content_hash"), cache.read(), model, version, embed).withColumnRenamed("content_hash", "text_hash")
    embedded = journal.write("embed", keyed.join(wanted, "document_id"), run)
    fresh = embedded.where("embedding_status = 'embedded'").select(
        F.col("text_hash").alias("content_hash"), "chunk_id", "embedding", "embedding_model", "embedding_version", F.col("embedded_at").alias("created_at"))
    embedding.store_cache(cache, fresh)
    # A document with a chunk that has no vector has not finished; the next run tries it again.
    whole = embedded.groupBy(*DOCUMENT).agg(F.count_if(F.col("embedding_status") == "failed").alias("failed"), F.count(F.lit(1)).alias("n")).where("failed = 0")
    journal.finish("embed", whole, run)

    wanted = materialize(journal.missing(documents.join(journal.done("embed"), DOCUMENT, "left_semi"), "upsert"), "wanted")
    given = journal.rows("embed", wanted, embedded.schema).withColumn("content_hash", F.col("text_hash"))
    vectors.upsert(given.select(*VECTOR_COLUMNS))
    journal.finish("upsert", _counted(wanted, journal.rows("embed", wanted, embedded.schema)), run)

    done = documents.join(journal.done("upsert"), DOCUMENT, "left_semi").select("document_id", F.lit(True).alias("_done")).distinct()
    outcome = F.when(F.col("processing_status") == "embedded", "skipped").when(F.col("_done"), "embedded").otherwise("failed")
    outcomes = materialize(registry.select("document_id", "processing_status").join(done, "document_id", "left").select("document_id", outcome.alias("outcome")), "outcomes")
    release(documents, wanted)
    return outcomes


def vector_table(spark: SparkSession, path: str, buckets: int = 64) -> SnapshotTable:
    """A vector table with the key document_id, for all chunks of a document to be replaced at once."""
    kinds = {"year": "int", "page_start": "int", "page_end": "int", "token_count": "int", "has_heading": "boolean", "contains_table": "boolean", "quality_score": "double", "embedding": "array<float>"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in VECTOR_COLUMNS)
    return SnapshotTable(spark, path, spark.createDataFrame([], schema).schema, ["document_id"], buckets)


def cache_table(spark: SparkSession, path: str, buckets: int = 64) -> SnapshotTable:
    kinds = {"embedding": "array<float>", "embedding_version": "int", "created_at": "timestamp"}
    names = ("content_hash", "chunk_id", "embedding", "embedding_model", "embedding_version", "created_at")
    return SnapshotTable(spark, path, spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names)).schema, embedding.CACHE_KEY, buckets)


def journaled_stream(files: DataFrame, out: str, register: Callable[[DataFrame], DataFrame], embed=embed_fn, buckets: int = 64) -> StreamingQuery:
    """Landed files (``path, content``) through the stages above; a batch that failed is taken up at each document's first missing stage."""
    spark = files.sparkSession

    def handle(batch: DataFrame, _: int) -> None:
        resume_documents_job(register(batch), batch, cache_table(spark, f"{out}/cache", buckets), vector_table(spark, f"{out}/vectors", buckets), StageJournal(spark, f"{out}/stages"), embed)

    return files.writeStream.foreachBatch(handle).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
