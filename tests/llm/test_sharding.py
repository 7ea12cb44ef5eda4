from __future__ import annotations

import zlib

from ledgerloom.llm import catalog, sharding
from tests.llm.conftest import SF


def _valid(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    n = [len(slots.get(k, [])) for k in range(shards)]
    assert max(n) - min(n) <= 1 and sum(n) == len(rows)


def test_permutation_and_back(spark):
    for n in (1, 2, 7, 8, 1000):
        df = spark.range(n).select("id")
        rows = sharding.place_of(df, "id", n, 8, 5)
        found = rows.collect()
        _valid(found, 8)
        back = sharding.number_at(rows, n, 8, 5).collect()
        assert all(r.row_number == r.id for r in back)
    other = {r.id: (r.shard, r.slot) for r in sharding.place_of(spark.range(1000).select("id"), "id", 1000, 8, 6).collect()}
    assert sum(other[r.id] == (r.shard, r.slot) for r in found) < 20


def test_odd_documents(docs_of):
    rows = [(i % 5, f"t{i % 3}") for i in range(30)] + [(None, None), (7, ""), (8, "é" * 9), (9, "x" * 300000)]
    found = sharding.shard_documents(docs_of(rows)).collect()
    _valid(found, 8)
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r.text_crc32) for r in found) == want
    again = sharding.shard_documents(docs_of(rows[::-1]).coalesce(1)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_empty(docs_of):
    assert sharding.shard_documents(docs_of([])).count() == 0


def test_query(spark):
    rows = catalog.op6_sharding(spark, SF).collect()
    _valid(rows, 8)
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32, r.law) for r in rows} == {i: (len(t) + 1, zlib.crc32(t), "rows") for i, t in texts.items()}
