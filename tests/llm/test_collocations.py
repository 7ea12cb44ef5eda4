"""Collocations against a count of every phrase in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import catalog, collocations
from tests.llm.conftest import SF

KIND = "doc_id long, lang string, text string, n long, w1 string, c long, phrase string"


def _brute(docs, words=3, least=10, share=50, top=2000):
    total, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, words + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    rows = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = {(lang, p[i:j]) for (lang, p), a in rows.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and 100 * a >= share * rows[lang, p[i:j]]}
    out = []
    for lang in total:
        scored = []
        for (own, p), a in rows.items():
            if own == lang and (own, p) not in gone:
                s, k, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, n + 1, p.decode(), -a, left, right, total[lang], -s) for n, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def _got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def _docs():
    rng = random.Random(5)
    vocabulary = ["the", "of", "New", "York", "new", "city", "Éa", "éa", "x y", "日本", "-", "a'b", "ß"]
    docs = [(None, None), ("en", ""), ("en", " \t "), ("und", "new york city, new york"), (None, "new york city")]
    for _ in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        docs.append((rng.choice(["en", "de", None]), "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "!? ", "\x0b"]) for w in words)))
    docs += [("en", "New York city is it")] * 15 + [("fr", "un deux trois quatre " * 12)] + [("one", f"p{i} q{i}" + " z" * (i % 3)) for i in range(9)]
    return docs


@pytest.mark.parametrize("words,least,share,top", [(3, 10, 50, 2000), (3, 2, 90, 7), (2, 10, 50, 2000), (4, 3, 50, None), (3, 300, 50, 5)])
def test_against_all_phrases(spark, words, least, share, top):
    docs = _docs()
    df = spark.createDataFrame([(i, *d, 1, "w", 2, "p") for i, d in enumerate(docs)], KIND).repartition(3)
    assert _got(collocations.collocations(df, words, least, share, top)) == _brute(docs, words, least, share, top)


def test_parts_and_a_full_bitmap(spark):
    """Texts longer than a part, pieces longer than a part, and a bitmap in which nearly all bits are set."""
    docs = [*_docs(), ("en", "new york city. " * 400), ("de", "alpha beta " * 900), ("de", "." * 3000 + "alpha beta")]
    df = spark.createDataFrame([(i, *d, 1, "w", 2, "p") for i, d in enumerate(docs)], KIND).repartition(3)
    for words in (2, 3, 4):
        got = collocations.collocations(df, words, chunk=1000, range_bytes=4096, filter_bits=10)
        assert _got(got) == _brute(docs, words)


def test_counts_past_32_bits_of_products(spark):
    docs = [("en", "big deal " * 70000)] * 3
    df = spark.createDataFrame([(i, *d, 1, "w", 2, "p") for i, d in enumerate(docs)], KIND)
    assert _got(collocations.collocations(df)) == _brute(docs)


def test_empty(spark):
    assert collocations.collocations(spark.createDataFrame([], KIND)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, 1, "w", 2, "p")], KIND)).count() == 0


def test_query(spark):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert _got(catalog.op11_collocations(spark, SF)) == _brute(docs)
