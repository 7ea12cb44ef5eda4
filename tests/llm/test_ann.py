from __future__ import annotations

import math
import random

import numpy as np

from ledgerloom.llm import ann, catalog
from tests.llm.conftest import SF

KIND = "vec_id long, embedding array<float>, label int, dim int, block long"


def _brute(rows, k=20, every=20, kind=np.float32):
    good = [(i, np.array(v, kind)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in good:
        if q % every == 0:
            found = []
            for i, x in good:
                if i != q and len(x) == len(v):
                    s = 0.0
                    for a, b in zip(x.tolist(), v.tolist(), strict=True):
                        s += a * b
                    found.append((-s, i))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def _got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_odd_vectors_in_small_tiles(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [(300, rows[3][1]), (320, None), (340, []), (360, [0.0] * 6), (380, [1.0, None, 1.0, 1.0, 1.0, 1.0]),
                                                          (400, [float("nan")] + [1.0] * 5), (401, [float("inf")] + [1.0] * 5), (420, [1e30] * 6), (421, [1e-30] * 6),
                                                          (440, [1.0, 2.0]), (441, [3.0, 1.0]), (None, [1.0] * 6), (-40, [0.5] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], KIND).repartition(3)
    for size in ({}, {"rows": 16, "queries": 4}):
        assert _got(ann.nearest(df, **size)) == _brute(rows)
    assert _got(ann.nearest(df, k=500, rows=32)) == _brute(rows, k=500)


def test_repeated_queries(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(90)]
    rows += [rows[20], rows[20], (40, [rng.gauss(0, 1) for _ in range(5)])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], KIND).repartition(3)
    got = _got(ann.nearest(df, rows=32, queries=2))
    assert got == _brute(rows) and len([r for r in got if r[0] == 20]) == 60 and len([r for r in got if r[0] == 40]) == 40


def test_long_vectors_and_doubles(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.0, 1.0)) * (1 + rng.random() * 1e-9) for _ in range(2500)]) for i in range(45)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, dim int")
    assert _got(ann.nearest(df, k=5, rows=16)) == _brute(rows, k=5, kind=np.float64)
    a, b = np.full((2, 4000), 127, np.int8), np.full((3, 4000), -127, np.int8)
    assert (ann.steps_product(a, b) == -127 * 127 * 4000).all()


def test_empty(spark):
    assert ann.nearest(spark.createDataFrame([], KIND)).count() == 0


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert _got(catalog.op8_nearest(spark, SF)) == _brute(rows)
