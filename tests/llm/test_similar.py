"""Links of the near-duplicate stage against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import similar


def _set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _classes(texts):
    """Smallest index reachable over pairs of a similarity of 0.8 or more."""
    sets, at, having = [_set(t) for t in texts], list(range(len(texts))), {}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        near = set().union(*(having.get(s, ()) for s in a)) if a else {j for j in range(i) if not sets[j]}
        for j in near:
            if not a or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                at[y] = x
        for s in a:
            having.setdefault(s, []).append(i)
    return [root(i) for i in range(len(texts))]


def _check(docs, rows):
    got = {}
    for r in rows:
        got.setdefault(r.root, set()).add(r.doc_id)
    want = {}
    for (i, _), g in zip(docs, _classes([t for _, t in docs]), strict=True):
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    return want


def _found(df):
    return similar.near_duplicates(df.withColumn("k", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.coalesce("text", F.lit(""))))), "k").collect()


def _texts():
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    line, texts = words(12), [None, "", " \n", "one two", "ONE two", "one two three four five", "one two three four six"]
    for n in (9, 30, 64, 200, 700):
        base = words(n)
        for edits in (0, 1, 1, 2, 3, 5, 8, 20, 40):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(n)] = f"x{rng.random()}"
            texts += [" ".join(own), " ".join(line + own)]
        # Exactly 0.8, and just below: n shingles of which the longer text has a quarter more.
        texts += [" ".join(base[:4 + (n - 4) * 4 // 5]), " ".join(base[:3 + (n - 4) * 4 // 5])]
    for i in range(60):  # a chain: neighbours are similar, its ends are not
        texts.append(" ".join(f"c{j}" for j in range(i * 4, i * 4 + 60)))
    return list(enumerate(texts))


def test_against_all_pairs(docs_of):
    docs = _texts()
    want = _check(docs, _found(docs_of(docs)))
    assert len(want) > 20 and max(map(len, want.values())) >= 60


def test_all_pairs_have_their_chance(docs_of):
    """Pairs of exactly 0.8 are found in all of 300 groups of three, in which the middle one is linked to both others."""
    rng, docs = random.Random(6), []
    for g in range(300):
        base = [f"g{g}w{rng.randrange(10 ** 6)}" for _ in range(44)]
        docs += [(3 * g, " ".join(base[:36])), (3 * g + 1, " ".join(base)), (3 * g + 2, " ".join(base[8:]))]
    want = _check(docs, _found(docs_of(docs)))
    assert len(want) == 300


def test_long_text(docs_of):
    rng = random.Random(2)
    long = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    docs = [(1, " ".join(long)), (2, " ".join([*long[:150_000], "other", *long[150_000:]])), (3, " ".join(long[:150_000])), (4, " ".join(long) + " and more")]
    _check(docs, _found(docs_of(docs)))


def test_template(docs_of):
    """Texts that share half of their shingles and all rare ones are not linked."""
    rng = random.Random(7)
    line = [f"t{i}" for i in range(40)]
    docs = [(i, " ".join([*line, *(f"w{rng.randrange(10 ** 6)}" for _ in range(30))])) for i in range(200)]
    want = _check(docs, _found(docs_of(docs)))
    assert len(want) == 200


def test_one_list_in_many_tiles():
    """Links of a list dealt out in blocks connect what all its pairs of 0.8 connect, and no more."""
    rng = random.Random(9)
    docs = [t for _, t in _texts() if t and len(t.split()) > 5]
    docs += [" ".join(["same"] * (i % 3) + [f"b{j}" if j != rng.randrange(70) else f"x{i}" for j in range(70)]) for i in range(60)]
    sets = [similar.shingles(t.encode()) for t in docs]
    for blocks in (1, 3):
        own = np.array([i * 7 % blocks for i in range(len(docs))])
        links = []
        for x in range(blocks):
            for y in range(x, blocks):
                part = [i for i in range(len(docs)) if own[i] in (x, y)]
                links += similar.joining_links([sets[i] for i in part], part, part, own[part] == x, own[part] == y)
        at = list(range(len(docs)))
        for _ in range(len(docs)):
            for u, v in links:
                at[u] = at[v] = min(at[u], at[v])
        assert at == _classes(docs) and len(links) < blocks * (blocks + 1) // 2 * len(docs)


def test_empty(docs_of):
    assert _found(docs_of([])) == []


def test_stage_on_the_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in df.collect())
    smallest = {docs[g][0] for g in _classes([t for _, t in docs])}
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()} == smallest


def test_fingerprint():
    """A bit is set if over half of the hashes have it; a tie falls to the smallest hash of the word, stirred once more."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 4, 9, 40, 255, 600):
        found = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        want = []
        for words in similar._mixed(found[None] + similar._OWN).tolist():
            tie = int(similar._mixed(np.array([min(words)], np.uint64))[0]) if words else 0
            want.append(sum(1 << b for b in range(64) if 2 * (ones := sum(w >> b & 1 for w in words)) > n or words and 2 * ones == n and tie >> b & 1))
        assert similar.fingerprint(found).view(np.uint64).tolist() == want


def _lists(df):
    stored = similar.described(df.withColumn("k", F.col("doc_id")), "k")
    met = {}
    for r in similar.met(similar.postings(stored.select("node", "size", "print").dropDuplicates(["node"]))).collect():
        met.setdefault(r.h, set()).add(r.node)
    return {r.doc_id: (r.node, r.print) for r in stored.collect()}, met


def test_links_meet_in_the_index(docs_of):
    """Every pair of 0.8 stands in a list of the byte-position index; texts without anything in common stand in none."""
    docs = _texts()
    rng = random.Random(8)
    alone = [(1000 + i, " ".join(f"a{rng.randrange(10 ** 9)}" for _ in range(5 + i % 90))) for i in range(3000)]
    node, met = _lists(docs_of(docs + alone))
    sets, links = [_set(t) for _, t in docs], 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a and node[i][0] != node[j][0] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links += 1
                assert any(node[i][0] in x and node[j][0] in x for x in met.values()), (i, j)
    chance = {n for i, (n, _) in node.items() if i >= 1000}
    assert links > 100 and not any(x & chance for x in met.values())


def test_long_lists_are_joined_like_short_ones(monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, (2, 40), dtype=np.uint64)
    checked = np.repeat(centres, 8, axis=1) ^ (np.uint64(1) << rng.integers(0, 64, (2, 320), dtype=np.uint64))
    h, node = np.repeat([3, 5], 160), rng.permutation(320)
    got = []
    for limit in (512, 4):
        monkeypatch.setattr(similar, "LONG", limit)
        groups = {}
        for name, member in zip(*similar.together(h, node, checked), strict=True):
            groups.setdefault(int(name), set()).add(int(member))
        got.append(sorted(map(sorted, groups.values())))
    assert got[0] == got[1] == sorted(sorted(node[i:i + 8].tolist()) for i in range(0, 320, 8))


def test_rows_come_through_the_index(docs_of, monkeypatch):
    """Without postings only copies have a root in common, so nothing beside the index links texts."""
    given = similar.postings
    monkeypatch.setattr(similar, "postings", lambda prints: given(prints).limit(0))
    docs = _texts()
    roots = {}
    for r in _found(docs_of(docs)):
        roots.setdefault(r.root, []).append(r.doc_id)
    assert all(len({frozenset(_set(docs[i][1])) for i in x}) == 1 for x in roots.values())


def test_members_are_compared_once_however_many_lists_they_share(docs_of, monkeypatch):
    """Near copies of one text, half of them less similar than 0.8 to all others: no set is taken up once for each of its lists."""
    given, taken = similar._joining, []

    def counted(open_lists, other):
        taken.append(open_lists.count())
        return given(open_lists, other)

    monkeypatch.setattr(similar, "_joining", counted)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    for n in (60, 120):
        docs = []
        for i in range(n):
            own = list(base)
            for at in rng.sample(range(150), i % 9):
                own[at] = f"x{rng.randrange(10 ** 9)}"
            docs.append((i, " ".join(own)))
        want = _check(docs, _found(docs_of(docs)))
        assert len(want) > n // 4 and max(map(len, want.values())) > n // 4
        assert taken.pop() <= n


def test_links_may_not_be_left_out(monkeypatch):
    """Rows of the first shingle that a pair of 0.8 of two roots shares are kept, in short and in long lists; most others are not."""
    rng = random.Random(12)
    base, sets = range(60), []
    for i in range(400):
        own = set(rng.sample(base, rng.randrange(40, 61)))
        sets.append(own | set(range(1000 + 50 * i, 1000 + 50 * i + rng.randrange(12))))
    n = {}
    for x in sets:
        for s in x:
            n[s] = n.get(s, 0) + 1
    root = [i % 150 for i in range(400)]
    places = [{s: k for k, s in enumerate(sorted(x, key=lambda s: (n[s], s)), 1)} for x in sets]
    rows = sorted((s, i, k) for i, x in enumerate(places) for s, k in x.items() if 5 * (k - 1) <= len(x) and n[s] > 1)
    s, i, k = (np.array(c) for c in zip(*rows, strict=True))
    for limit in (512, 4):
        monkeypatch.setattr(similar, "LONG", limit)
        kept = similar.may_link(s, np.array(root)[i], np.array([len(x) for x in sets])[i], k)
        having, links = {(a, b) for a, b, _ in np.array(rows)[kept].tolist()}, 0
        for a in range(400):
            for b in range(a):
                both = sets[a] & sets[b]
                if root[a] != root[b] and 5 * len(both) >= 4 * len(sets[a] | sets[b]):
                    first = min(both, key=lambda s: (n[s], s))
                    links += 1
                    assert (first, a) in having and (first, b) in having
        assert links > 50 and (limit == 4 or len(having) < len(rows))
