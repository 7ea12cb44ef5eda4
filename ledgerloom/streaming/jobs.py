"""Structured Streaming jobs: continuous ingestion of landed files, and quote freshness."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.ingestion import VECTOR_COLUMNS, Ingested, apply_outcomes, embed_documents_job

QUOTE_TTL_SECONDS = 30
NEWS_TTL_SECONDS = 240


def ingest_batch(out: str, cache: DataFrame, register: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Handler of one micro-batch of files: vectors, progress and the registry rows with their new status are written under its number.

    Writing replaces the folder of the batch, so a batch that is run again after a
    failure leaves the same files.  ``read_vectors`` and ``read_registry`` give the current rows.
    """
    def handle(files: DataFrame, batch: int) -> None:
        known = register(files)
        done: Ingested = embed_documents_job(known, files, cache)
        apply_outcomes(known, done.outcomes).write.mode("overwrite").parquet(f"{out}/registry/batch={batch}")
        done.embedded.select(*VECTOR_COLUMNS).write.mode("overwrite").parquet(f"{out}/vectors/batch={batch}")
        done.progress().write.mode("overwrite").parquet(f"{out}/progress/batch={batch}")
    return handle


def ingest_stream(files: DataFrame, out: str, cache: DataFrame, register: Callable[[DataFrame], DataFrame],
                  available_now: bool = True) -> StreamingQuery:
    """Landed files (``path, content``) to vector and progress tables; restarts from its checkpoint."""
    writer = (files.writeStream.foreachBatch(ingest_batch(out, cache, register))
              .option("checkpointLocation", f"{out}/checkpoint"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def _last_batch(rows: DataFrame) -> DataFrame:
    """Rows of the last batch that wrote a document; only id and number are grouped."""
    last = rows.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["document_id", "batch"], "left_semi").drop("batch")


def read_vectors(spark: SparkSession, out: str) -> DataFrame:
    """One generation of chunks per document: those of the last landing that gave any."""
    return _last_batch(spark.read.parquet(f"{out}/vectors"))


def read_registry(spark: SparkSession, out: str) -> DataFrame:
    """One row per document, with the status after its last landing."""
    return _last_batch(spark.read.parquet(f"{out}/registry"))


def read_files_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.format("binaryFile").schema(schema)
            .option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(path))


def latest_values(stream: DataFrame, key: str, ts: str, value: str, order: Sequence[str] = ()) -> DataFrame:
    """Latest known value per key; a failed fetch (null) leaves the value before it.

    Of values of one time that with the largest ``order`` columns counts, then the largest.  The state is one row per key and partial maxima meet before the shuffle, so a key
    with very many updates is no hot task.
    """
    good = stream.where(F.col(value).isNotNull())
    return good.groupBy(key).agg(F.max_by(value, F.struct(ts, *order, value)).alias("value"), F.max(ts).alias("as_of"), F.count(F.lit(1)).alias("updates"))


def freshness(latest: DataFrame, now, ttl_seconds: int = QUOTE_TTL_SECONDS) -> DataFrame:
    """Whether the value of a key may still be served without a new fetch."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("as_of").cast("timestamp"))
    return latest.withColumn("fresh", age < ttl_seconds * 1_000_000)


def throttled(stream: DataFrame, key: str, ts: str, ttl_seconds: int = QUOTE_TTL_SECONDS) -> DataFrame:
    """At most one fetch request per key inside the time to live."""
    return stream.withWatermark(ts, f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark([key])


def quote_cache_stream(ticks: DataFrame, out: str, key: str = "ticker", ts: str = "ts", value: str = "price",
                       order: Sequence[str] = ()) -> StreamingQuery:
    """Changed keys of every batch under its number; ``read_quotes`` gives the current table."""
    def handle(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/quotes/batch={batch}")

    return (latest_values(ticks, key, ts, value, order).writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())


def read_quotes(spark: SparkSession, out: str, key: str = "ticker") -> DataFrame:
    rows = spark.read.parquet(f"{out}/quotes")
    fields = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), "batch").alias("v")).select(key, "v.*")
