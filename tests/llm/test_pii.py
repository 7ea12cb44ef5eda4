from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from ledgerloom.llm import catalog, pii
from tests.llm.conftest import SF

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _good(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        s = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in s) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def _spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if _good(k, m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


ODD = ["", None, "a@b.com", "a@b.com_x@y.org z@w", "x..y@d-e.f.g. é𝄞 q@r.s", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.0003.4 1.2.3", "4111 1111 1111 1111",
       "4111-1111-1111-1112", "4111  1111 1111 1111", "card 4111111111111111 visa", "+49 (30) 1234-5678, +1.2", "+1 2 3", "++44 20 7946 0958 +44 20 7946 0958",
       "𝄞𝄞 mail joe@x.io 10.0.0.1\n10.0.0.1", "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001", "12 " * 2000, "1" * 2000,
       "a." * 600 + "a@" + "b." * 600 + "c", "a@b.c " * 1000, "9" * 13 + " +" + "9" * 16, "-@-.-"]


def test_base_spans(docs_of):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "a@b.com"), (2, "a@b.com")]
    found = pii.find_spans(docs_of(rows), out="found")
    assert {"spans", "_body", "fp"} <= set(found.columns)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.j) for r in found.select("doc_id", pii.joined(F.col("found"), pii.BASE).alias("j")).collect())
    assert got == sorted((i is None, i or 0, _spans(t)) for i, t in rows)


def test_very_long_runs(docs_of):
    texts = ["7" * 1_000_000, "1 " * 500_000, "a." * 500_000, "a@" + "b." * 300_000 + "c", "+" + "1-" * 300_000, "1." * 60_000]
    found = pii.find_spans(docs_of(list(enumerate(texts))), out="found").select("doc_id", F.size("found").alias("n")).collect()
    assert {r.doc_id: r.n for r in found} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 0, 5: 15_000}


def test_iban_checksum_context_and_mask(docs_of):
    text = "my iban DE89 3704 0044 0532 0130 00 or DE89370400440532013001, card 4111111111111111, serial +4930123456789"
    row = pii.find_spans(docs_of([(1, text)]), out="s").withColumn("m", pii.masked(F.col("text"), F.col("s"))).first()
    by = {s.kind: s for s in row.s}
    assert by["iban"].value == "DE89 3704 0044 0532 0130 00" and by["iban"].score == 1.0
    assert by["card"].score == 0.8 and by["phone"].score == 0.6
    assert row.m == "my iban [IBAN] or DE89370400440532013001, card [CARD], serial [PHONE]"


def test_empty(docs_of):
    assert pii.find_spans(docs_of([])).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: hashlib.sha256(_spans(r.text).encode()).hexdigest() for r in rows}
    got = catalog.op3_pii(spark, SF).collect()
    assert {r.doc_id: r.base_sha256 for r in got} == want
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 0
