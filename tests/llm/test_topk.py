"""Exact top-k of whole-number vectors against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import catalog, topk
from ledgerloom.llm.vectors import MOST
from tests.llm.conftest import SF

KIND = "vec_id long, embedding array<double>, label int, dim int, block long, row long, norm double"


def whole(vector, scale):
    """The vector's components as whole numbers; None if it takes no part."""
    if vector is None or any(x is None or not math.isfinite(x) or math.isinf(x * scale) for x in vector):
        return None
    return [math.floor(x * scale) for x in vector]


def product(a, b):
    return max(-MOST, min(MOST, sum(x * y for x, y in zip(a, b, strict=True))))


def _brute(rows, k=20, every=20, scale=64):
    good = [(i, w) for i, v in rows if i is not None and (w := whole(v, scale)) is not None]
    out = []
    for q, v in good:
        if q % every == 0:
            found = sorted((-product(v, x), i) for i, x in good if i != q and len(x) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def _got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in df.collect())


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5.0) for i, v in rows], KIND).repartition(5)


def odd_rows():
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 7) ** 2 / 9 for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(600 + i, [x + rng.gauss(0, 0.02) for x in rows[20][1]]) for i in range(40)]
    rows += [(300, rows[3][1]), (320, None), (340, []), (341, []), (360, [0.0] * 6), (380, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (399, [-0.001] * 6),
             (400, [float("nan")] + [1.0] * 5), (401, [float("inf")] + [1.0] * 5), (422, [1.7e308] * 6), (440, [1.0, 2.0]), (441, [3.0, 1.0]), (None, [1.0] * 6), (-40, [0.5] * 6),
             (60, rows[5][1]), (60, rows[6][1]), (61, rows[5][1]), (61, rows[5][1])]
    return rows


@pytest.mark.parametrize("size", [{}, {"rows": 16, "queries": 4}, {"rows": 3, "queries": 1, "k": 5}, {"k": 500, "rows": 32}])
def test_odd_vectors_in_small_buckets(spark, size):
    rows = odd_rows()
    assert _got(topk.top_k(_frame(spark, rows), **size)) == _brute(rows, size.get("k", 20))


def test_products_beyond_doubles_and_longs(spark):
    rows = [(i, [float(2 ** (10 * (i % 8))) * (-1) ** i, 3.0 + i, 1e15 + 2 * i]) for i in range(60)] + [(100, [1e300, -1e300, 5.0]), (101, [1e300, 1e300, 5.0])]
    assert _got(topk.top_k(_frame(spark, rows), k=7, rows=8, queries=2)) == _brute(rows, 7)


def test_both_ways_are_used(spark, monkeypatch):
    """Near copies are found by coordinates, far vectors by length; both skip vectors."""
    rng = np.random.default_rng(1)
    far = rng.normal(size=(300, 16))
    far *= 4 / np.linalg.norm(far, axis=1)[:, None]
    near = far[0] + rng.normal(size=(40, 16)) * 1e-3
    bucket_x = np.floor(np.concatenate([near, far]) * 64)
    norm = np.linalg.norm(bucket_x, axis=1)
    order = np.argsort(-norm)
    ids = np.arange(len(norm))[order]
    bucket = topk.Bucket(16, len(norm), ids.tobytes(), norm[order].tobytes(), bucket_x[order].tobytes())
    q = topk.Queries(16, 2, np.arange(2).tobytes(), np.array([0, 45]).tobytes(), norm[[0, 45]].tobytes(), bucket_x[[0, 45]].tobytes(), 20)
    checked = []
    monkeypatch.setattr(topk, "products", lambda a, b: checked.append((len(a), len(b))) or (a @ b.T).astype(np.int64))
    q.meet(bucket)
    assert checked == [(2, 340)]
    assert q.floor()[0] > 0.99 * norm[0] ** 2 and q.floor()[1] < 0.9 * norm[45] * norm[0]
    q.meet(bucket)
    by_coordinates, by_length = checked[1:]
    assert by_coordinates[0] == 1 and by_coordinates[1] <= 41 and by_length == (1, 340)


def test_empty(spark):
    assert topk.top_k(_frame(spark, [])).count() == 0
    assert topk.top_k(_frame(spark, [(1, [1.0]), (2, None)])).count() == 0


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert _got(catalog.op12_topk(spark, SF)) == _brute(rows)


def test_queries_and_buckets_are_never_joined(spark):
    """A join would send whole blocks to the driver when their size is misjudged, and make a row of each pair."""
    plan = topk.top_k(_frame(spark, odd_rows()), rows=3, queries=1)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not [line for line in joins if "slot" in line]


@pytest.mark.parametrize("held", [1, 400, 1 << 20])
def test_slots_hold_whole_buckets_up_to_a_size(spark, monkeypatch, held):
    monkeypatch.setattr(topk, "HELD", held)
    rows = odd_rows()
    good = topk.numbered(_frame(spark, rows), 64).persist()
    buckets = topk._blocks(good, 4, topk.RATIO).withColumn("level", topk._level(F.col("longest"))).persist()
    slots = topk._places(buckets).selectExpr("*", "n * greatest(dim, 1) * 8 AS bytes").groupBy("dim", "level", "slot").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
    assert sum(s.n for s in slots) == buckets.count()
    assert all(s.n == 1 or s.bytes < 2 * max(held, 4 * 6 * 8) for s in slots)
    by_level = {}
    for s in slots:
        by_level.setdefault((s.dim, s.level), []).append(s.slot)
    assert all(sorted(found) == list(range(len(found))) for found in by_level.values())
    assert _got(topk.top_k(_frame(spark, rows), rows=4, queries=2)) == _brute(rows)
