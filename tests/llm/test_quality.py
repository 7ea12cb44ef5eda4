from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import catalog, quality
from tests.llm.conftest import SF


def test_rules_compile_to_what_was_fitted(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.6) & (x[:, 3] < 0.5) | (x[:, 7] > 0.9)).astype(float)
    model = quality.fit(x, y)
    assert model["rules"] and len(model["rules"]) < len(quality.extract_rules(x, y))
    df = spark.createDataFrame([(v.tolist(),) for v in x[:500]], "stats array<double>").withColumn("s", quality.score(model))
    got = np.array([r.s for r in df.collect()])
    want = np.full(500, model["intercept"])
    for f, low, high, w in model["linear"]:
        want += (np.clip(x[:500, f], low, high) - low) * w
    for rule, w in model["rules"]:
        want += w * quality._holds(x[:500], rule)
    assert np.allclose(got, 1 / (1 + np.exp(-want)))
    assert ((got >= 0.5) == y[:500]).mean() > 0.97


def test_odd_documents(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, " \n "), (4, "x" * 500_000), (5, "WORD!! " * 20), (5, "WORD!! " * 20), (None, "é 𝄞")])
    for labels in ([], [(1, 1), (2, None), (3, 1)], [(1, 1), (1, 0), (4, 0), (99, 1)]):
        found = quality.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(found) == 7 and all(0 <= r.score <= 1 for r in found) and "fp" in found[0].asDict()
    assert quality.scored(docs_of([]), spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert {r.score for r in quality.scored(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()} == {0.5}


@pytest.mark.parametrize("folder", [SF, SF.replace("0.001", "0.01")])
def test_query_on_held_out_rows(spark, folder):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = catalog.op7_quality(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(known) > 20 and sum(p == q for p, q in known) / len(known) > 0.95


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, labels) == quality.train(docs, flipped)
