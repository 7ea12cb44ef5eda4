"""Each stage against what the operators' brute-force versions say about its input."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from ledgerloom.llm import catalog
from tests.llm.conftest import SF
from tests.llm.test_decontam import _brute as contaminated
from tests.llm.test_packing import _got as pieces
from tests.llm.test_packing import _valid, _want
from tests.llm.test_pii import _spans
from tests.llm.test_similar import _classes


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(100001, None, None, None, None), (100002, "", "en", "s", 0), (None, "mail me at a@b.com or 10.0.0.1 today", "en", "s", 36),
                                   (None, "another text without an id that says something else", "en", "s", 51), (100003, "twice the same", "en", "s", 14), (100003, "twice the same", "en", "s", 14)], docs.schema)
    docs, seen = docs.unionByName(extra).withColumn("score", F.lit(1)).withColumn("_kept", F.lit("k")), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{n}")
        after = spark.read.parquet(f"{tmp_path}/{n}")
        assert n == len(corpus_pipeline.STAGES) - 1 or after.columns == docs.columns
        seen.append((name, docs.collect(), after.collect()))
        docs = after
    texts = lambda rows: [(r.doc_id, r.text) for r in rows]
    ids = lambda rows: sorted((r.doc_id for r in rows), key=str)
    by = {name: (a, b) for name, a, b in seen}

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in by["quality"][1]}
    known = [(r.doc_id in kept, labels[r.doc_id] == 1) for r in by["quality"][0] if r.doc_id in labels]
    assert sum(a == b for a, b in known) / len(known) > 0.95 and len(by["quality"][1]) < len(by["quality"][0])

    given = sorted(texts(by["near_duplicates"][0]), key=lambda x: (x[0] is not None, x[0] or 0))
    groups = _classes([t for _, t in given])
    smallest = {}
    for (i, _), g in zip(given, groups, strict=True):
        smallest[g] = i if smallest.get(g) is None else min(smallest[g], i if i is not None else smallest[g])
    assert list(smallest.values()).count(None) > 1
    assert ids(by["near_duplicates"][1]) == sorted(smallest.values(), key=str)

    items = texts(spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "doc_id").collect())
    clean = [d for d, _, hit, _ in contaminated(texts(by["decontamination"][0]), items) if not hit]
    assert ids(by["decontamination"][1]) == sorted(clean, key=str) and len(clean) < len(by["decontamination"][0])

    before, masked = by["personal_data"]
    assert ids(before) == ids(masked)
    assert {x for x in texts(before) if not _spans(x[1])} <= set(texts(masked))
    assert not any(_spans(r.text) for r in masked) and any(_spans(r.text) for r in before)
    assert all(r.n_chars == len(r.text) for r in masked if r.text)

    before, rows = by["packing"]
    assert pieces(rows) == _want(texts(before))
    _valid(rows, 2048)


def test_run_is_registered(spark):
    rows = catalog.queries()["pipeline"](spark, SF).collect()
    assert rows and _valid(rows, 2048) > 0
