"""Tables kept in versions: what an upsert rewrites, what a crash leaves, and equality with plain upserts."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import embedding, registry
from ledgerloom.sources.snapshots import SnapshotTable, VersionExists

ROWS = "id string, v long, tags array<string>"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, [str(v)]) for i, v in rows], ROWS)


def stored(spark, tmp_path, buckets=8):
    return SnapshotTable(spark, str(tmp_path / "t"), frame(spark, []).schema, ["id"], buckets)


def values(df):
    return {r.id: (r.v, r.tags) for r in df.collect()}


def test_two_upserts_and_a_crash(spark, tmp_path):
    t = stored(spark, tmp_path)
    assert (t.version(), t.read().count(), t.folders()) == (0, 0, {})
    assert t.upsert(frame(spark, [(f"k{i}", i) for i in range(100)])) == 1
    first = t.folders()
    assert set(first) == set(range(8))
    assert t.upsert(frame(spark, [("k3", -3), ("new", 7)])) == 2
    second = t.folders()
    changed = {b for b in second if second[b] != first[b]}
    assert 1 <= len(changed) <= 2
    want = {f"k{i}": (i, [str(i)]) for i in range(100)} | {"k3": (-3, ["-3"]), "new": (7, ["7"])}
    assert values(t.read()) == want and len(values(t.read(1))) == 100 and values(t.read(1))["k3"] == (3, ["3"])

    def broken(old, rows):
        return old.unionByName(rows).withColumn("v", F.raise_error(F.lit("a lost node")).cast("long"))

    with pytest.raises(Exception, match="a lost node"):
        t.upsert(frame(spark, [("k4", -4)]), broken)
    assert (t.version(), t.folders(), values(t.read())) == (2, second, want)
    again = stored(spark, tmp_path)
    assert again.upsert(frame(spark, [("k4", -4)])) == 3
    assert values(again.read()) == want | {"k4": (-4, ["-4"])}


def test_files_of_untouched_buckets_stay(spark, tmp_path):
    t = stored(spark, tmp_path)
    t.upsert(frame(spark, [(f"k{i}", i) for i in range(50)]))
    files = lambda: {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    before = files()
    t.upsert(frame(spark, [("k1", 0)]))
    assert before.items() <= files().items() and len(files()) == len(before) + 1


def test_the_second_of_two_writers_fails(spark, tmp_path):
    a, b = stored(spark, tmp_path), stored(spark, tmp_path)

    def slow(old, rows):
        b.upsert(frame(spark, [("b", 2)]))
        return old.unionByName(rows)

    with pytest.raises(VersionExists):
        a.upsert(frame(spark, [("a", 1)]), slow)
    assert values(a.read()) == {"b": (2, ["2"])}
    assert a.upsert(frame(spark, [("a", 1)])) == 2 and set(values(b.read())) == {"a", "b"}
    assert not list((tmp_path / "t" / "manifests").glob("*.draft"))


def test_a_batch_is_applied_once(spark, tmp_path):
    t = stored(spark, tmp_path)
    add = lambda old, rows: old.unionByName(rows)
    for batch in (0, 0, 1, 1, 0):
        t.upsert(frame(spark, [(f"r{batch}", batch)]), add, "stream", batch)
    assert sorted(r.id for r in t.read().collect()) == ["r0", "r1"] and (t.version(), t.applied("stream"), t.applied("other")) == (2, 1, -1)


def test_delete_empty_batches_and_expiry(spark, tmp_path):
    t = stored(spark, tmp_path, 2)
    t.upsert(frame(spark, [(f"k{i}", i) for i in range(10)]))
    t.upsert(frame(spark, []))
    assert t.folders(1) == t.folders(2)
    t.delete(frame(spark, [(f"k{i}", 0) for i in range(9)] + [("none", 0)]))
    assert set(values(t.read())) == {"k9"}
    t.delete(frame(spark, [("k9", 0)]))
    assert t.read().count() == 0 and t.folders() == {}
    t.upsert(frame(spark, [("x", 1)]))
    assert t.versions() == [1, 2, 3, 4, 5]
    assert len(t.expire(1)) == 3 and t.versions() == [5] and set(values(t.read())) == {"x"}


def test_other_keys_or_columns_are_refused(spark, tmp_path):
    stored(spark, tmp_path).upsert(frame(spark, [("a", 1)]))
    with pytest.raises(ValueError):
        SnapshotTable(spark, str(tmp_path / "t"), frame(spark, []).schema, ["v"])
    with pytest.raises(ValueError):
        SnapshotTable(spark, str(tmp_path / "t"), frame(spark, []).drop("v").schema, ["id"])
    assert SnapshotTable(spark, str(tmp_path / "t"), frame(spark, []).schema, ["id"], 999).buckets == 8


def test_registry_and_cache_in_versions(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    schema = ("document_id string, ticker string, company_name string, doc_type string, title string, year int, quarter string, file_path string, file_size long, "
              "source string, source_url string, checksum_sha256 string, processing_status string, updated_at timestamp, pos long")
    batches = [[(f"D{i % (7 + n)}", "t", f"n{i}", "a", f"x{i}", 2024, None, None if i % 3 else f"f{i}", i % 4, "s", None, "", f"s{n}", t0, n * 100 + i) for i in range(20)] for n in range(3)]
    empty = spark.createDataFrame([], schema).drop("pos").withColumn("download_date", F.col("updated_at")).select(*registry.REGISTRY_COLUMNS)
    plain, kept = empty, SnapshotTable(spark, str(tmp_path / "r"), empty.schema, ["document_id"], 4)
    for b in batches:
        rows = spark.createDataFrame(b, schema)
        plain = registry.registry_upsert(plain, rows)
        registry.store_updates(kept, rows)
    assert sorted(map(str, kept.read().collect())) == sorted(map(str, plain.collect())) and kept.version() == 3
    cache = "content_hash string, chunk_id string, embedding array<float>, embedding_model string, embedding_version int, created_at timestamp"
    rows = [spark.createDataFrame([(f"h{i % 5}", f"c{i}{n}", [float(i), float(n)], "m", 1 + i % 2, t0 + dt.timedelta(seconds=i)) for i in range(9)], cache) for n in range(2)]
    kept = SnapshotTable(spark, str(tmp_path / "c"), rows[0].schema, embedding.CACHE_KEY, 4)
    plain = rows[0].limit(0)
    for r in rows:
        plain = embedding.cache_put(plain, r)
        embedding.store_cache(kept, r)
    assert sorted(map(str, kept.read().collect())) == sorted(map(str, plain.collect()))
