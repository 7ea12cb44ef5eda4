from __future__ import annotations

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from ledgerloom.llm import catalog, packing
from tests.llm.conftest import SF


def _valid(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def _want(docs, capacity=2048):
    tokenizer = Tokenizer.from_file(catalog.tokenizer_path())
    out = []
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out += [(d, n, s, len(ids[s:s + capacity]), zlib.crc32(np.array(ids[s:s + capacity], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=str)


def _got(rows):
    return sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)


def test_odd_documents(docs_of):
    odd = ["", None, "It's we'll 'Tis I'M 12 3.4", "ÀÉÖ straße ÿ İ ǅ ﬁ", "á é", "日本 語 𝄞 🙂", "<|endoftext|> x <| y", " a b\x1cc\x85d", "½²ª", "x" * 20000,
           "wörd " * 9000, "a_b--c!!..?", "\0\x01 a", "don’t “quote”", "퟿"]
    docs = [*enumerate(odd), (1, "again"), (1, "again"), (None, "null id")]
    rows = packing.pack_documents(docs_of(docs), catalog.tokenizer_path(), cell=8).collect()
    assert _got(rows) == _want(docs)
    _valid(rows, 2048)


def test_packing_is_close_to_full_and_migrates(spark):
    rng = random.Random(4)
    lengths = [rng.choice([rng.randint(1, 60), rng.randint(200, 900), rng.randint(1000, 2048)]) for _ in range(1500)]
    parts = spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)], "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")
    for cell in (2048, 150):
        rows = packing.pack(parts, cell=cell).collect()
        assert len(rows) == 1500 and _valid(rows, 2048) <= 1.02 * -(-sum(lengths) // 2048) + 1


def test_crossover_keeps_every_document():
    rng = random.Random(6)
    sizes = [rng.randint(1, 100) for _ in range(200)]
    a, b = packing.evolve(np.array(sizes, np.int32), [], 1, 100, 0, 2)
    bins, free = packing.cross(packing.groups(a), packing.groups(b), sizes, 100, rng)
    assert sorted(i for g in bins for i in g) == list(range(200))
    assert all(f == 100 - sum(sizes[i] for i in g) >= 0 for g, f in zip(bins, free, strict=True))


def test_equal_halves_do_not_loop(spark):
    parts = spark.createDataFrame([(i, i, 0, 0, 1100, 0) for i in range(100)], "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")
    assert _valid(packing.pack(parts, cell=10).collect(), 2048) == 100


def test_empty(docs_of):
    assert packing.pack_documents(docs_of([]), catalog.tokenizer_path()).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = catalog.op10_packing(spark, SF).collect()
    assert _got(rows) == _want(docs)
    assert _valid(rows, 2048) <= -(-sum(r.length for r in rows) // 2048) + 1
