"""The cache with a time to live: request by request, over restarts, and with timers."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np

from ledgerloom.streaming import ttl

T0 = dt.datetime(2024, 1, 1)
ROWS = "ticker string, ts timestamp, id long, price double, note string"


def walk(rows, seconds, keep=None, known=None):
    """One request after the other; rows of (at in seconds, value or None)."""
    out = []
    for at, value in rows:
        if known and at < known[1] + seconds:
            out.append(("served", *known))
        elif value is not None:
            known = (value, at)
            out.append(("fetch", *known))
        elif known and (keep is None or at < known[1] + keep):
            out.append(("stale", *known))
        else:
            out.append(("failed", None, None))
    return out, known


def test_answers_against_a_walk():
    rng = random.Random(1)
    for _ in range(500):
        n, seconds, keep = rng.randrange(30), rng.choice([1, 5, 20]), rng.choice([None, 25])
        at = sorted(rng.randrange(120) for _ in range(n))
        rows = [(t, None if rng.random() < 0.5 else float(rng.randrange(9))) for t in at]
        known = rng.choice([None, (7.0, 0), (7.0, 60)])
        answer, given, as_of, after = ttl.answers(np.array(at, np.int64), np.array([np.nan if v is None else v for _, v in rows], float), seconds, keep, known)
        got = [(a, None if np.isnan(g) else g, None if np.isnan(g) else int(t)) for a, g, t in zip(answer, given, as_of, strict=True)]
        want, known = walk(rows, seconds, keep, known)
        assert got == want and after == known


def land(spark, folder, name, rows):
    spark.createDataFrame([(k, T0 + dt.timedelta(seconds=t), i, v, "x") for k, t, i, v in rows], ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(spark, folder, out, **given):
    stream = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    ttl.ttl_stream(stream, str(out), "ticker", "ts", "id", "price", 30, **given).awaitTermination()
    rows = spark.read.parquet(f"{out}/answers").collect()
    return {r.id: (r.answer, r.price, None if r.as_of is None else int((r.as_of - T0).total_seconds())) for r in rows}, len(rows)


def test_goes_on_from_its_checkpoint(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"K{rng.randrange(4)}", 3 * i, i, None if rng.random() < 0.4 else float(i)) for i in range(200)]
    want = {}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        want |= dict(zip([r[2] for r in own], walk([(r[1], r[3]) for r in own], 30)[0], strict=True))
    for part in range(4):
        land(spark, tmp_path / "in", f"p{part}", rows[part * 50:(part + 1) * 50])
        got, n = run(spark, tmp_path / "in", tmp_path / "out")
        assert n == (part + 1) * 50 and got == {i: want[i] for i in range(n)}
    assert run(spark, tmp_path / "in", tmp_path / "out") == (want, 200)


def test_old_values_are_forgotten(spark, tmp_path):
    batches = [[("A", 0, 0, 5.0), ("A", 40, 1, None), ("B", 50, 2, 6.0)], [("B", 900, 3, 1.0)], [("B", 905, 4, 2.0)], [("A", 910, 5, None), ("A", 911, 6, 8.0), ("B", 2000, 7, None)]]
    for n, rows in enumerate(batches):
        land(spark, tmp_path / "in", f"p{n}", rows)
        got, _ = run(spark, tmp_path / "in", tmp_path / "out", keep_seconds=100)
    assert got == {0: ("fetch", 5.0, 0), 1: ("stale", 5.0, 0), 2: ("fetch", 6.0, 50), 3: ("fetch", 1.0, 900), 4: ("served", 1.0, 900),
                   5: ("failed", None, None), 6: ("fetch", 8.0, 911), 7: ("failed", None, None)}


def test_no_requests(spark, tmp_path):
    land(spark, tmp_path / "in", "p", [])
    stream = spark.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ttl.ttl_stream(stream, str(tmp_path / "out"), "ticker", "ts", "id", "price", 30).awaitTermination()
