from __future__ import annotations

import hashlib
import random

from ledgerloom.llm import catalog, repeats, suffixes
from tests.llm.conftest import SF


def _brute(docs):
    """Per document in order: bytes, removed, spans, digest; a string counts from its second start on."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if (w := b[i:i + 100]) in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def _got(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(1500):
        x = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(0, 40))]
        assert suffixes.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])
    assert suffixes.suffix_array([3] * 2000) == list(range(1999, -1, -1))


def _texts():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé𝄞 ") for _ in range(rng.randint(2, 9)))
    base = " ".join(word() for _ in range(400))
    passage = " ".join(word() for _ in range(30))
    docs = [(1, base), (2, base[:500] + "X" + base[500:]), (3, base), (4, None), (5, ""), (6, "q" * 99), (7, "r" * 100), (8, "r" * 350),
            (9, ("ab" * 40 + "c") * 30), (10, passage + base[300:420]), (11, "zz" + passage), (12, passage[1:] + "y"), (13, base[100:199]), (14, base[100:230]),
            (None, base[1000:1400]), (20, base[::-1] + "Z" + base[700:900]), (21, "\0" * 250)]
    return docs + [(30 + i, f"{rng.random()}{passage}{rng.random()}" * 3) for i in range(40)]


def test_odd_documents(docs_of):
    docs = _texts()
    assert _got(repeats.remove_repeats(docs_of(docs))) == _brute(docs)


def test_small_chunks_and_batches(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 256)
    monkeypatch.setattr(repeats, "SORTED_TOGETHER", 5)
    monkeypatch.setattr(repeats, "SEEN", 3)
    docs = _texts()
    raw = dict(docs)[1].encode()
    want = repeats.segments(__import__("numpy").frombuffer(raw[:300], "u1"), __import__("numpy").arange(201))
    assert (want[2] >= 0).all() and (want[3] >= 0).all() and (want[4] <= repeats.SIDE).all()
    assert _got(repeats.remove_repeats(docs_of(docs))) == _brute(docs)


def test_repeated_rows_and_ids(docs_of):
    a, b = "one " * 10 + "".join(map(str, range(200))), "".join(map(str, range(500, 700)))
    rows = repeats.remove_repeats(docs_of([(1, a), (1, a), (1, b), (2, a)])).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in rows) == sorted([(1, len(b), 0), (1, len(a), 0), (1, len(a), 0), (2, len(a), len(a))])
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


def _ordered_brute(docs):
    """As _brute, for (id, text) with repeated ids: texts of one id in the order that the operator states, null ids first."""
    out, seen = [], set()
    for d, t, _ in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[2])):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if (w := b[i:i + 100]) in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(w)
        out.append((d, len(b), sum(gone)))
    return sorted(out, key=str)


def test_texts_of_one_id_whose_hashes_agree_in_17_bits(spark, docs_of):
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(314)) for _ in range(1500)]
    hashed = [r.h for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").selectExpr("xxhash64(t) AS h").collect()]
    by = {}
    for i, h in enumerate(hashed):
        by.setdefault(h % (1 << 17), []).append(i)
    pair = next(v for v in by.values() if len(v) > 1)
    a, b = (texts[i] for i in pair[:2])
    other = "x" * 50 + a[20:200] + "y" * 50
    for ids in ((None, None, None, None), (7, 7, 7, None), (-(1 << 63), None, -(1 << 63), None)):
        docs = list(zip(ids, (a, b, other, other[:180]), strict=True))
        tags = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "i int, t string").orderBy("i").selectExpr("xxhash64(t) AS h").collect()
        keyed = [(d, t, (r.h | -(1 << 63)) if d is None else r.h & ((1 << 63) - 1)) for (d, t), r in zip(docs, tags, strict=True)]
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(docs_of(docs)).collect()), key=str)
        assert got == _ordered_brute(keyed)


def test_anchors_with_many_contents(docs_of):
    """A phrase of 40 and one of 130 bytes in many documents: their windows are dealt out instead of sorted."""
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    short, long, near = some(40), some(130), some(70)
    docs = [(i, some(rng.randrange(150)) + short + some(rng.randrange(120)) + long + (near if i % 3 else some(9)) + some(rng.randrange(150))) for i in range(120)]
    for limit in (1, 10, 60, 4096):
        assert _got(repeats.remove_repeats(docs_of(docs), limit)) == _brute(docs)
    assert _got(repeats.remove_repeats(docs_of(_texts()), 1)) == _brute(_texts())


def test_empty(docs_of):
    assert repeats.remove_repeats(docs_of([])).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert _got(catalog.op5_suffix_dedup(spark, SF)) == _brute(docs)
