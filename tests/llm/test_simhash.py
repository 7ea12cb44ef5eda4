from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from ledgerloom.llm import catalog, components, simhash
from tests.llm.conftest import SF


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def _print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", _lower(t or ""))
    parts = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def _classes(prints):
    """Smallest index reachable over links of at most three bits."""
    at = list(range(len(prints)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = sorted((root(i), root(j)))
                at[y] = x
    return [root(i) for i in range(len(prints))]


def test_sets_of_positions():
    from itertools import combinations
    assert len(simhash.BLOCKS) == 14
    assert all(any(not set(bad) & set(b) for b in simhash.BLOCKS) for bad in combinations(range(8), 3))


def test_documents(docs_of):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base.replace("w200", "x200")), (1, None), (2, ""), (4, " \t\n"), (7, "One"), (8, "oNE two"), (6, "one"),
            (10, "é ü x y"), (11, "long " * 30000), (5, base), (None, base)]
    found = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs_of(rows)).collect()}
    prints = {i: _print(t) for i, t in rows}
    assert {(i, f % (1 << 64)) for i, f in found} == {(i, p) for i, p in prints.items()}
    ids = sorted((i for i in prints if i is not None))
    want = dict(zip(ids, [ids[k] for k in _classes([prints[i] for i in ids])], strict=True))
    assert {i: c for (i, _), c in found.items() if i is not None} == want
    assert found[(None, next(f for i, f in found if i is None))] == 3
    assert simhash.near_duplicates(docs_of(rows)).count() == len(rows)


def test_links_of_close_fingerprints_and_long_lists(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for limit in (4096, 4):
        df = spark.createDataFrame([(p,) for p in signed], "fp long")
        roots = {r.u % (1 << 64): r.root % (1 << 64) for r in components.components(simhash.links(df, limit)).collect()}
        got = {}
        for p in prints:
            got.setdefault(roots.get(p, p), set()).add(p)
        want = {}
        for p, c in zip(prints, _classes(prints), strict=True):
            want.setdefault(c, set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, 200 + i) for i in range(50)]
    found = {r.u: r.root for r in components.components(spark.createDataFrame(chain + star + [(3, 3)], "u long, v long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, 7: 7, **{200 + i: 7 for i in range(50)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = sorted(r.doc_id for r in rows)
    prints = {r.doc_id: _print(r.text) for r in rows}
    want = {i: (f"{prints[i]:016x}", ids[k]) for i, k in zip(ids, _classes([prints[i] for i in ids]), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.op2_simhash(spark, SF).collect()} == want
    assert isinstance(prints[ids[0]], int) and np.uint64(prints[ids[0]]) >= 0
