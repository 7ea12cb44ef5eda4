"""Vector helpers: a deterministic text embedding and cosine arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions import text as T

EMBED_DIM = 64
EMBED_MODEL = "hashing-64"
WORD = r"[\p{L}\p{M}\p{N}_]+"


def embed_fn(c) -> Column:
    """Default vectoriser: signed counts of hashed words, scaled to unit length; any column function of text to array<float> may replace it.

    A word's slot and sign are seven bits of its MD5.  A text becomes one character for each word, and a
    slot's count is how many of its characters are there.  A text without words, or whose words cancel
    each other out, has an empty vector; null stays null.
    """
    words = F.regexp_extract_all(F.lower(T.col(c)), F.lit(WORD), F.lit(0))
    signs = F.array_join(F.transform(words, lambda w: F.char(F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int") % (2 * EMBED_DIM))), "")

    def count(s: Column, i: Column) -> Column:
        return F.octet_length(F.replace(s, F.char(i + EMBED_DIM), F.lit(""))) - F.octet_length(F.replace(s, F.char(i), F.lit("")))

    def scaled(v: Column) -> Column:
        return F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x * x))),
                           lambda n: F.transform(F.filter(v, lambda _: n > 0), lambda x: (x / n).cast("float")))[0]

    # Bound in arrays of one element, so that words are hashed and counted once.
    counts = F.transform(F.array(signs), lambda s: F.transform(F.sequence(F.lit(0), F.lit(EMBED_DIM - 1)), lambda i: count(s, i)))
    return F.when(T.col(c).isNotNull(), F.transform(counts, scaled)[0])


def register(spark) -> None:
    """``embed_text`` for SQL: the same vectoriser as a function of the session, without Python."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION embed_text(t STRING) RETURNS ARRAY<FLOAT> RETURN
      if(t IS NULL, NULL, transform(transform(transform(
        array(array_join(transform(regexp_extract_all(lower(t), r'{WORD}', 0),
                                   w -> char(cast(conv(substring(md5(w), 1, 2), 16, 10) AS int) % {2 * EMBED_DIM})), '')),
        s -> transform(sequence(0, {EMBED_DIM - 1}), i -> octet_length(replace(s, char(i + {EMBED_DIM}), '')) - octet_length(replace(s, char(i), '')))),
        v -> struct(v AS v, sqrt(aggregate(v, 0L, (a, x) -> a + x * x)) AS n)),
        b -> transform(filter(b.v, x -> b.n > 0), x -> cast(x / b.n AS float)))[0])""")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v) -> Column:
    """Vector scaled to length one, done once when vectors are written."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm).cast("float"))
