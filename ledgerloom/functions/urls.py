"""URL column helpers.

URLs are taken apart with the pattern of RFC 3986 appendix B, which accepts what a
crawler meets; java.net.URI would reject much of it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions import text as T

_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
# Query parameters that only track the visit.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "ref")
# A country label behind one of these general labels is a public suffix of two labels everywhere.
_GENERAL = "com|co|net|ne|org|or|gov|govt|gob|gouv|go|edu|ac|mil"
_COUNTRY_SUFFIX = rf"^(?:{_GENERAL})\.[a-z]{{2}}$"
# Further two-label public suffixes; others end in one label.
TWO_LABEL_SUFFIXES = ("firm.in", "gen.in", "ind.in", "ltd.uk", "plc.uk", "me.uk")


def part(url, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty when absent."""
    return F.regexp_extract(T.col(url), _PARTS, i)


def decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def query_param(url, *names: str) -> Column:
    """Decoded value of the first of ``names`` that the query holds, null without one."""
    q = part(url, 4)
    found = [T.truthy(decode(F.regexp_extract(q, rf"(?:^|&){n}=([^&]*)", 1))) for n in names]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def host(url) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^[^@]*@", ""), ":[0-9]*$", ""))


def canonicalize_url(url) -> Column:
    """Lower-case host, no fragment, no end slash, tracking parameters removed, the rest sorted."""
    path = F.regexp_replace(part(url, 3), ";[^/]*$", "")
    path = F.when(path != "/", F.regexp_replace(path, "/+$", "")).otherwise(path)
    pieces = F.filter(F.split(part(url, 4), "&"), lambda p: p.rlike("^[^=]*=."))
    pairs = F.array_sort(F.transform(pieces, lambda p, i: F.struct(
        decode(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), decode(F.regexp_replace(p, "^[^=]*=", "")).alias("v"))))
    names = F.transform(pairs, lambda p: p["k"])
    first = F.filter(F.zip_with(pairs, F.concat(F.array(F.lit(None).cast("string")), F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0)))),
                                lambda p, before: F.struct(p["k"].alias("k"), p["v"].alias("v"), before.alias("b"))),
                     lambda x: x["k"].isNotNull() & ~F.coalesce(x["k"] == x["b"], F.lit(False)) & ~x["k"].isin(*TRACKING))
    query = F.array_join(F.transform(first, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "&")
    scheme, authority = F.lower(part(url, 1)), F.lower(part(url, 2))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""),
        path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def registrable_domain(url) -> Column:
    """Public suffix and the label before it."""
    h = F.regexp_replace(F.when(part(url, 2) != "", host(url)).otherwise(F.lower(F.regexp_extract(T.col(url), "^([^/?#:]*)", 1))), r"\.$", "")
    two = F.substring_index(h, ".", -2)
    wide = (two.isin(*TWO_LABEL_SUFFIXES) | two.rlike(_COUNTRY_SUFFIX)) & (h != two)
    return F.when(~F.contains(h, F.lit(".")), F.concat(h, F.lit("."))).when(wide, F.substring_index(h, ".", -3)).otherwise(two)


def same_domain(a, b) -> Column:
    return registrable_domain(a) == registrable_domain(b)
