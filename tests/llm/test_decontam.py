from __future__ import annotations

import hashlib
import re

from ledgerloom.llm import catalog, decontam
from tests.llm.conftest import SF


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def _brute(docs, items):
    windows = {}
    for i, t in items:
        w = _words(t)
        for s in [w] if 0 < len(w) < 10 else [w[j:j + 10] for j in range(len(w) - 9)]:
            windows.setdefault(tuple(s), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, which = _words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j:j + n])) in windows:
                    hit.update(range(j, j + n))
                    which |= windows[k]
        out.append((d, len(w), len(hit), sorted(map(str, which))))
    return sorted(out, key=str)


def _got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in df.collect()), key=str)


def test_odd_documents(spark, docs_of):
    run = " ".join(f"w{i}" for i in range(14))
    items = [(1, run), (2, "Short One"), (3, ""), (4, None), (10, run), (5, "a a a a a a a a a a a"), (6, "never seen anywhere at all")]
    docs = [(1, f"x {run.upper()}, y"), (2, None), (3, ""), (4, "--- !!"), (5, "short-one... SHORT one"), (6, "a " * 3000), (7, run), (7, run),
            (7, run + " more"), (None, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"), (8, "W0 É ü w1"), (9, "w13 w12 w11 w10 w9 w8 w7 w6 w5 w4 w3 w2 w1 w0")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    assert _got(decontam.contamination(docs_of(docs), bench)) == _brute(docs, items)
    near = {r.doc_id: r.n_near_items for r in decontam.contamination(docs_of(docs), bench).collect()}
    assert near[9] == 2 and near[8] == 0


def test_several_blocks_of_phrases(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontam, "PHRASE_BLOCK", 3)
    items = [(i, " ".join(f"v{i}x{j}" for j in range(12))) for i in range(6)]
    docs = [(i, f"a {t} b {items[i - 1][1]}") for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert _got(decontam.contamination(docs_of(docs), bench)) == _brute(docs, items)


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs_of([]), none).count() == 0
    assert _got(decontam.contamination(docs_of([(1, "a b")]), none)) == [(1, 2, 0, [])]


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(((d, n, h, len(w), hashlib.sha256(",".join(w).encode()).hexdigest(), h > 0) for d, n, h, w in _brute(docs, items)), key=str)
    got = catalog.op4_decontamination(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == want
    assert any(r.contaminated for r in got)
