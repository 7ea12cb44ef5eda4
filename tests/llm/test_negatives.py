"""Hard negatives against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerloom.llm import catalog, negatives
from tests.llm.conftest import SF
from tests.llm.test_topk import odd_rows, product, whole

KIND = "vec_id long, embedding array<double>, label int, dim int, block long, row long, positives long"


def _brute(rows, every=50, positives=5, n=3, low=50, high=95, scale=256):
    good = [(i, w, label) for i, v, label in rows if i is not None and label is not None and (w := whole(v, scale)) is not None]
    out = []
    for a, v, label in good:
        if a % every == 0:
            found = sorted((-product(v, x), i, other) for i, x, other in good if i != a and len(x) == len(v))
            for s, p, _ in [f for f in found if f[2] == label][:positives]:
                inside = [(i, -t) for t, i, other in found if other != label and low * -s <= 100 * -t <= high * -s][:n]
                out += [(a, p, rank + 1, i, -s, t) for rank, (i, t) in enumerate(inside)]
    return sorted(out)


def _got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], KIND).repartition(5)


def _labelled(labels):
    rng = random.Random(4)
    return [(i, v, None if n % 17 == 0 else rng.randrange(labels)) for n, (i, v) in enumerate(odd_rows())]


@pytest.mark.parametrize("labels,size", [(3, {}), (3, {"rows": 16, "anchors": 2}), (90, {"rows": 16, "anchors": 4}), (1, {}), (4, {"every": 10, "positives": 2, "negatives": 7, "low": 20, "high": 100})])
def test_odd_vectors_in_small_blocks(spark, labels, size):
    rows = _labelled(labels)
    want = _brute(rows, *(size.get(k, d) for k, d in (("every", 50), ("positives", 5), ("negatives", 3), ("low", 50), ("high", 95))))
    assert _got(negatives.hard_negatives(_frame(spark, rows), **size)) == want
    assert want or labels == 1


def test_one_label_holds_most_rows_and_ties(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(3)) for _ in range(4)], 0 if i % 3 else i % 5) for i in range(300)]
    for size in ({"every": 15}, {"every": 15, "rows": 20, "anchors": 3}):
        assert _got(negatives.hard_negatives(_frame(spark, rows), **size)) == _brute(rows, 15)


def test_products_beyond_doubles(spark):
    rows = [(i, [float(2 ** (10 * (i % 8))), 3.0 + i, 1e14 + 2 * i], i % 2) for i in range(60)] + [(100, [1e300, -1e300, 5.0], 0), (101, [1e300, 1e300, 5.0], 1)]
    assert _got(negatives.hard_negatives(_frame(spark, rows), every=10, rows=8)) == _brute(rows, 10)


def test_reading_stops_at_the_threshold():
    """Lists are not read to their end when the windows are settled."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(4096, 3)) * 256)
    order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
    block = negatives.Candidates(3, len(x), np.arange(len(x)).tobytes(), np.zeros(len(x), np.int64).tobytes(), x.tobytes(), order.tobytes())
    scored = []

    class Counted(negatives.Window):
        def push(self, score, ids):
            scored.append(len(score))
            super().push(score, ids)

    q = np.array([300.0, -200.0, 100.0])
    window = Counted(-negatives.MOST, negatives.MOST, 5)
    negatives.threshold_search(q, block, np.ones(len(x), bool), [window])
    assert sum(scored) < 1500
    assert window.score.tolist() == sorted((x @ q).astype(int).tolist())[-5:][::-1]


def test_empty(spark):
    assert negatives.hard_negatives(_frame(spark, [])).count() == 0
    assert negatives.hard_negatives(_frame(spark, [(50, [1.0], None), (100, None, 1), (150, [1.0], 1)])).count() == 0


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label if r.vec_id % 7 or r.label is None else (r.label + 1) % 10) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert _got(catalog.op13_hard_negatives(spark, SF)) == _brute(rows)
