"""String column helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters str.strip() and \s treat as white space.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
              "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every kind of Unicode white space, not only U+0020."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def rstrip(c) -> Column:
    return F.rtrim(col(c), F.lit(WHITESPACE))


def blank(c) -> Column:
    """True for null or white-space-only text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def squeeze(c) -> Column:
    """Collapse white-space runs to one space and trim."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def lines_of(c) -> Column:
    return F.split(col(c), "\n", -1)


def keep_lines(c, keep) -> Column:
    """Text with only the lines for which ``keep(line)`` holds."""
    return F.array_join(F.filter(lines_of(c), keep), "\n")


def any_keyword(text: Column, keywords) -> Column:
    """Does any keyword occur in ``text`` as a substring?

    The text is bound as the one element of an array, so that what computes it runs once
    and not once per keyword; a null text has no keyword.
    """
    def found(t):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(t, F.lit(k))
        return hit

    return F.coalesce(F.exists(F.array(text), found), F.lit(False))


def truthy(c) -> Column:
    """Null for an empty string, the string otherwise."""
    return F.nullif(col(c), F.lit(""))
