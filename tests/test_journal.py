"""Ingestion with a journal: a failed stage is taken up again without those before it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.vectors import embed_fn
from ledgerloom.plans import ingestion, journal
from ledgerloom.streaming import jobs
from tests.test_jobs import CACHE, known, landed


def tables(spark, out):
    return journal.cache_table(spark, f"{out}/cache", 4), journal.vector_table(spark, f"{out}/vectors", 4), journal.StageJournal(spark, f"{out}/stages")


def broken(_):
    return F.raise_error(F.lit("provider is down")).cast("array<float>")


def stages_of(j):
    return {(r.document_id, r.stage): (r.run, r.n) for r in j.entries().collect()}


def test_goes_on_at_the_embed_stage(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files = landed(spark, tmp_path / "in")
    kept = tables(spark, tmp_path / "out")
    with pytest.raises(Exception, match="provider is down"):
        journal.resume_documents_job(known(files), files, *kept, embed=broken)
    before = stages_of(kept[2])
    assert {s for _, s in before} == {"extract", "chunk"} and {d for d, _ in before} == {"f0", "f1", "f2", "f9"}
    assert kept[1].read().count() == 0 and kept[1].version() == 0

    def written(stage):
        return spark.read.parquet(f"{tmp_path}/out/stages/rows/{stage}").groupBy("run").count().count()

    outcomes = journal.resume_documents_job(known(files), files, *kept)
    assert {r.document_id: r.outcome for r in outcomes.collect()} == {"f0": "embedded", "f1": "embedded", "f2": "embedded", "f3": "skipped", "f9": "failed"}
    after = stages_of(kept[2])
    assert before.items() <= after.items() and written("extract") == written("chunk") == 1
    assert {k for k in after if k[1] in ("embed", "upsert")} == {(d, s) for d in ("f0", "f1", "f2") for s in ("embed", "upsert")}
    plain = ingestion.embed_documents_job(known(files), files, spark.createDataFrame([], CACHE))
    assert sorted(r.chunk_id for r in kept[1].read().collect()) == sorted(r.chunk_id for r in plain.embedded.collect())
    assert kept[0].read().count() == plain.embedded.select("content_hash").distinct().count()
    order = [r.stage for r in kept[2].progress().where("document_id = 'f0'").orderBy("position").collect()]
    times = [r.finished_at for r in kept[2].progress().where("document_id = 'f0'").orderBy("position").collect()]
    assert order == list(journal.STAGES) and times == sorted(times)

    journal.resume_documents_job(known(files), files, *kept, embed=broken)
    assert stages_of(kept[2]) == after


def test_changed_content_goes_through_all_stages_and_replaces_its_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files, kept = landed(spark, tmp_path / "in"), tables(spark, tmp_path / "out")
    journal.resume_documents_job(known(files), files, *kept)
    (tmp_path / "in" / "f1.html").write_text("<html><body>" + "".join(f"<p>Margin of the segment fell in year {y} by a point.</p>" for y in range(40)) + "</body></html>")
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    embedded = []

    def counted(text):
        embedded.append(1)
        return embed_fn(text)

    journal.resume_documents_job(known(files), files, *kept, embed=counted)
    entries = kept[2].entries().groupBy("document_id", "stage").count().collect()
    assert {(r.document_id, r["count"]) for r in entries} == {("f0", 1), ("f1", 2), ("f2", 1), ("f9", 1)}
    texts = [(r.document_id, r.text) for r in kept[1].read().collect()]
    assert {d for d, _ in texts} == {"f0", "f1", "f2"} and all("Margin" in t for d, t in texts if d == "f1")


def test_stream_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    files, out = landed(spark, tmp_path / "in"), str(tmp_path / "out")

    def run(embed):
        stream = jobs.read_files_stream(spark, str(tmp_path / "in"), files.schema, 100)
        journal.journaled_stream(stream, out, known, embed, 4).awaitTermination()

    with pytest.raises(Exception, match="provider is down"):
        run(broken)
    kept = tables(spark, out)
    first = stages_of(kept[2])
    run(embed_fn)
    assert first.items() <= stages_of(kept[2]).items() and {r.document_id for r in kept[1].read().collect()} == {"f0", "f1", "f2"}
    versions = kept[1].versions()
    run(broken)
    assert kept[1].versions() == versions
