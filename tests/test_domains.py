"""Public suffix rules: plain ones, wildcards, exceptions, and hosts that no rule knows."""

from __future__ import annotations

from ledgerloom.operators.domains import registrable_domains

RULES = ["com", "biz", "uk", "co.uk", "jp", "ac.jp", "kyoto.jp", "ide.kyoto.jp", "*.kobe.jp", "!city.kobe.jp", "*.ck", "!www.ck", "CO.in", "in"]
CASES = {
    "example.com": "example.com", "b.example.com": "example.com", "a.b.example.com": "example.com", "com": None, "WwW.Example.COM": "example.com",
    "domain.biz": "domain.biz", "biz": None, "example.co.uk": "example.co.uk", "b.example.co.uk": "example.co.uk", "co.uk": None, "other.uk": "other.uk",
    "jp": None, "test.jp": "test.jp", "www.test.jp": "test.jp", "ac.jp": None, "test.ac.jp": "test.ac.jp", "kyoto.jp": None, "test.kyoto.jp": "test.kyoto.jp",
    "ide.kyoto.jp": None, "b.ide.kyoto.jp": "b.ide.kyoto.jp", "a.b.ide.kyoto.jp": "b.ide.kyoto.jp", "c.kobe.jp": None, "b.c.kobe.jp": "b.c.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp",
    "city.kobe.jp": "city.kobe.jp", "www.city.kobe.jp": "city.kobe.jp", "ck": None, "test.ck": None, "b.test.ck": "b.test.ck", "a.b.test.ck": "b.test.ck",
    "www.ck": "www.ck", "www.www.ck": "www.ck", "example": None, "example.example": "example.example", "a.b.example.example": "example.example", "shop.co.in.": "shop.co.in"}


def test_rules(spark):
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    urls = spark.createDataFrame([(i, f"https://user@{h}:8080/x?y=1") for i, h in enumerate(CASES)] + [(900, None), (901, "no host"), (902, "https://b.example.com")], "id int, url string").repartition(3)
    got = {r.id: r.domain for r in registrable_domains(urls, "url", rules).collect()}
    assert got == dict(enumerate(CASES.values())) | {900: None, 901: None, 902: "example.com"}
    assert {r.domain for r in registrable_domains(urls, "url", rules.limit(0)).where("id < 3").collect()} == {"example.com"}
