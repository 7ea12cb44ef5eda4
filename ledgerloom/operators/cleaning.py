"""Cleaning of extracted page text: line filters, repeated lines, line repair.

Every step is a column expression over one page, so a page chain runs without a
shuffle.  Only the search for repeated headers and footers groups by document.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions import text as T

CLEANING_VERSION = "v1"
EDGE_LINES = 3
REPEAT_SHARE = 0.4
MIN_PAGES = 5
FOLD_PIECE = 512

# Line patterns of the cleaning rules.
ARTIFACT_LINE = (r"(?U)^(?:https?://\S+|http://fasb\.org/.*|http://xbrl\.org/.*|\d{10}|P\d+[YMWD]"
                 r"|(?i:true|false)|[a-z]+-\d{8}|0{5,}\d+)$")
PAGE_NUMBER_LINE = (r"(?U)(?i)^(?:-?\s*\d{1,4}\s*-?|page\s+\d{1,4}(?:\s+of\s+\d{1,4})?|[ivxlcdm]+)$")
HEADING_LINE = (r"(?U)^(?:(?i:PART|ITEM|SECTION|CHAPTER|SCHEDULE|ANNEXURE|EXHIBIT)\s"
                r"|[A-Z][A-Z\s&,\-]{5,}$|\d+[.)]\s+[A-Z]|[ivxIVX]+[.)]\s|(?i:Notes?)\s+\d)")
BULLET_LINE = ("(?U)^(?:[-•‣▪◦●○■□–—➢*]\\s"
               "|\\d+[.)]\\s|[a-z][.)]\\s|\\((?i:[a-z0-9ivx]+)\\)\\s)")
# Counts the groups [$₹]?\\s*[\\d,]+\\.?\\d*: what may stand before the digits does not change their number.
NUMBER_GROUP = r"[\p{Nd},]+\.?\p{Nd}*"
# Characters that are in NFC beside any other of these, so that a text of them needs no look at its marks.
COMPOSED = (r"^[\x{0}-\x{2FF}]*+(?:[\x{400}-\x{482}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}\x{3001}-\x{3029}\x{3041}-\x{3096}"
            r"\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FF01}-\x{FF60}]++[\x{0}-\x{2FF}]*+)*+$")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize_unicode(c) -> Column:
    """NFC form; rows of characters that have no other form skip Python."""
    c = T.col(c)
    return F.coalesce(_nfc(F.when((F.octet_length(c) > F.length(c)) & ~c.rlike(COMPOSED), c)), c)


def remove_control_characters(c) -> Column:
    return F.regexp_replace(T.col(c), r"[\p{C}&&[^\n\r\t]]+", "")


def remove_xbrl_artifacts(c) -> Column:
    return T.keep_lines(c, lambda line: ~T.strip(line).rlike(ARTIFACT_LINE))


def normalize_whitespace(c) -> Column:
    single = F.regexp_replace(F.replace(T.col(c), F.lit("\t"), F.lit(" ")), " {2,}", " ")
    return F.array_join(F.transform(T.lines_of(single), T.rstrip), "\n")


def remove_page_numbers(c) -> Column:
    return T.keep_lines(c, lambda line: ~T.strip(line).rlike(PAGE_NUMBER_LINE))


def digit_pattern(line: Column) -> Column:
    """A trimmed line with every digit run replaced by '#'."""
    return F.regexp_replace(T.strip(line), r"\p{Nd}+", "#")


def remove_repeated_lines(c, patterns) -> Column:
    patterns = F.coalesce(T.col(patterns), F.array().cast("array<string>"))
    return T.keep_lines(c, lambda line: (T.strip(line) == "") | ~F.array_contains(patterns, digit_pattern(line)))


def _edge_patterns(lines: Column) -> Column:
    """Patterns that count once for a page: a trimmed line is left out when it equals
    the pattern of an earlier line, so a line holding digits always counts."""
    marked = F.transform(lines, lambda line, i: F.struct(
        T.strip(line).alias("s"), digit_pattern(line).alias("p"),
        F.transform(F.slice(lines, 1, i), digit_pattern).alias("before")))
    kept = F.filter(marked, lambda x: (x["s"] != "") & ~F.array_contains(x["before"], x["s"]))
    return F.transform(kept, lambda x: x["p"])


def repeated_lines(pages: DataFrame, top_n: int = EDGE_LINES, share: float = REPEAT_SHARE,
                   min_pages: int = MIN_PAGES) -> DataFrame:
    """Header and footer patterns per document: ``document_id, side, pattern, hits``.

    One pass over the page edges; counts combine before the shuffle.
    """
    lines = T.lines_of(T.strip("text"))
    edges = pages.select("document_id", lines.alias("l")).select(
        "document_id", F.slice("l", 1, top_n).alias("top"),
        F.slice("l", -F.least(F.lit(top_n), F.size("l")), F.lit(top_n)).alias("bottom"))
    sided = edges.select("document_id", F.explode(F.array(
        F.struct(F.lit("header").alias("side"), _edge_patterns(F.col("top")).alias("p")),
        F.struct(F.lit("footer").alias("side"), _edge_patterns(F.col("bottom")).alias("p")))).alias("e"))
    counts = (sided.select("document_id", F.col("e.side").alias("side"), F.explode("e.p").alias("pattern"))
              .groupBy("document_id", "side", "pattern").agg(F.count(F.lit(1)).alias("hits"))
              .where(F.col("hits") >= min_pages))
    sizes = (pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"))
             .where(F.col("n_pages") >= min_pages))
    needed = F.greatest(F.lit(min_pages), F.floor(F.col("n_pages") * share))
    return (counts.join(sizes, "document_id").where(F.col("hits") >= needed)
            .select("document_id", "side", "pattern", "hits"))


def patterns_per_document(repeated: DataFrame) -> DataFrame:
    """At most a handful of patterns qualify per document, so they fit an array."""
    def side(name):
        return F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("pattern"))))
    return repeated.groupBy("document_id").agg(side("header").alias("headers"), side("footer").alias("footers"))


def fix_broken_lines(c) -> Column:
    """Join lines cut by the page width."""
    return _join_broken(F.transform(T.lines_of(c), lambda line: F.struct(line.alias("line"), T.strip(line).alias("s"))))


def _join_broken(lines: Column) -> Column:
    """Lines (struct of line and trimmed line) of one page as one text, cut lines joined.

    Whether a line continues the one before depends on both lines, and on how many number
    groups the joined line holds so far (they add up, because a continuation starts with a
    letter).  Only that last part needs a fold; it carries one digit per line, in pieces of
    FOLD_PIECE lines, so that the time does not grow with the square of the page.  What a
    line adds to the text then follows from its own digit and the next one's.
    """
    def facts(x):
        local = (x["s"].rlike(r"^\p{IsLowercase}") & ~F.contains(x["s"], F.lit("|"))
                 & ~x["s"].rlike(HEADING_LINE) & ~x["s"].rlike(BULLET_LINE))
        return F.struct(x["line"].alias("line"), x["s"].alias("s"), F.coalesce(local, F.lit(False)).alias("local"))

    def flags(b):
        def flag(x, i):
            # A line joined before has at least 20 characters and no pipe, whatever its last piece.
            before, after = F.get(b["l"], i - 1), F.get(b["l"], i + 1)
            ended = F.substring(T.rstrip(before["line"]), -1, 1).isin(*".!?;:")
            base = ~F.contains(before["s"], F.lit("|")) & (F.length(before["s"]) >= 20)
            # Groups are counted only beside a line that may continue another; nothing asks for the others.
            groups = F.when(x["local"] | F.coalesce(after["local"], F.lit(False)), F.regexp_count(x["s"], F.lit(NUMBER_GROUP)))
            return F.struct(F.coalesce(x["local"] & ~ended, F.lit(False)).alias("may"),
                            F.coalesce(base, F.lit(False)).alias("base"), F.coalesce(groups, F.lit(0)).alias("groups"))

        return F.transform(b["l"], flag)

    start = F.struct(F.lit("").alias("digits"), F.lit(0).alias("groups"), F.lit(False).alias("joined"))

    def step(acc, x):
        joins = x["may"] & (acc["joined"] | x["base"]) & (acc["groups"] < 3) & (x["groups"] < 3)
        return F.struct(F.concat(acc["digits"], F.when(joins, "1").otherwise("0")).alias("digits"),
                        F.when(joins, acc["groups"] + x["groups"]).otherwise(x["groups"]).alias("groups"), joins.alias("joined"))

    def piece(acc, f):
        own = F.struct(F.lit("").alias("digits"), acc["groups"].alias("groups"), acc["joined"].alias("joined"))
        return F.transform(F.array(F.aggregate(f, own, step)), lambda r: F.struct(
            F.concat(acc["digits"], r["digits"]).alias("digits"), r["groups"].alias("groups"), r["joined"].alias("joined")))[0]

    def pieces(b):
        at = F.sequence(F.lit(0), ((F.size(b["f"]) - 1) / FOLD_PIECE).cast("int"))
        return F.transform(at, lambda i: F.slice(b["f"], i * FOLD_PIECE + 1, F.lit(FOLD_PIECE)))

    def added(b):
        follows = F.concat(F.slice(b["d"], 2, F.size(b["d"])), F.array(F.lit("0")))
        own = F.zip_with(b["l"], b["d"], lambda x, d: F.when(d == "1", x["s"]).otherwise(x["line"]))

        def cut(text, more):
            end = T.rstrip(text)
            glue = F.when(F.endswith(end, F.lit("-")), F.substring(end, F.lit(1), F.length(end) - 1)).otherwise(F.concat(end, F.lit(" ")))
            return F.when(more == "1", glue).otherwise(F.concat(text, F.lit("\n")))

        return F.zip_with(own, follows, cut)

    # Each step is bound in an array of one element, so that no later one works it out again per line.
    def joined(b):
        folded = F.transform(F.array(flags(b)), lambda f: F.struct(f.alias("f")))
        folded = F.transform(folded, lambda x: F.struct(b["l"].alias("l"), F.split(F.aggregate(pieces(x), start, piece)["digits"], "").alias("d")))
        return F.transform(F.transform(folded, lambda x: F.array_join(added(x), "")), lambda t: F.substring(t, F.lit(1), F.length(t) - 1))[0]

    bound = F.transform(F.array(F.transform(lines, facts)), lambda ls: F.struct(ls.alias("l")))
    return F.transform(bound, lambda b: F.when(F.exists(b["l"], lambda x: x["local"]), joined(b)).otherwise(
        F.array_join(F.transform(b["l"], lambda x: x["line"]), "\n")))[0]


def normalize_paragraphs(c) -> Column:
    def short(t):
        return T.strip(F.when(F.contains(t, F.lit("\n" * 4)), F.regexp_replace(t, "\n{4,}", "\n\n\n")).otherwise(t))

    return F.transform(F.array(T.col(c)), short)[0]


def clean_page(c, headers, footers) -> Column:
    """The nine steps for one page.

    The steps between control characters and line repair look at one line at a time, so
    they are one pass over the lines: white space first, then one test for lines to drop.
    """
    none = F.array().cast("array<string>")
    repeated = F.concat(F.coalesce(T.col(headers), none), F.coalesce(T.col(footers), none))
    text = F.replace(remove_control_characters(normalize_unicode(c)), F.lit("\t"), F.lit(" "))
    spaced = F.transform(T.lines_of(F.regexp_replace(text, " {2,}", " ")), T.rstrip)
    lines = F.transform(spaced, lambda line: F.struct(line.alias("line"), T.strip(line).alias("s")))

    def kept(b):
        def stays(x):
            dropped = (x["s"].rlike(ARTIFACT_LINE) | x["s"].rlike(PAGE_NUMBER_LINE)
                       | ((F.size(b["r"]) > 0) & F.array_contains(b["r"], F.regexp_replace(x["s"], r"\p{Nd}+", "#"))))
            return (x["s"] == "") | ~dropped

        return _joined_or_blank(F.filter(b["l"], stays))

    # Bound in arrays of one element, so that no step is worked out again.
    return normalize_paragraphs(F.transform(F.array(F.struct(lines.alias("l"), repeated.alias("r"))), kept)[0])


def _joined_or_blank(lines: Column) -> Column:
    """A page that lost all its lines is one blank line."""
    blank = F.array(F.struct(F.lit("").alias("line"), F.lit("").alias("s")))
    return F.transform(F.array(lines), lambda ls: _join_broken(F.when(F.size(ls) == 0, blank).otherwise(ls)))[0]


def clean_document(pages: DataFrame) -> DataFrame:
    """Cleaned pages of all documents; input ``document_id, page, text, ...``."""
    patterns = patterns_per_document(repeated_lines(pages))
    joined = pages.join(patterns, "document_id", "left")
    cleaned = joined.withColumn("clean_text", clean_page("text", "headers", "footers"))
    rest = [c for c in pages.columns if c not in ("text", "char_count")]
    return cleaned.select(
        *rest, F.col("text").alias("raw_text"), "clean_text",
        F.length("text").alias("char_count_raw"), F.length("clean_text").alias("char_count_clean"),
        "headers", "footers", F.lit(CLEANING_VERSION).alias("cleaning_version"))


def clean_statistics(cleaned: DataFrame) -> DataFrame:
    raw, clean = F.col("raw_characters"), F.col("clean_characters")
    reduction = F.when(raw > 0, F.round((raw - clean) / raw * 100, 1)).otherwise(F.lit(0.0))
    return cleaned.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_pages"), F.sum("char_count_raw").alias("raw_characters"),
        F.sum("char_count_clean").alias("clean_characters"),
        F.coalesce(F.max(F.size("headers")), F.lit(0)).alias("headers_detected"),
        F.coalesce(F.max(F.size("footers")), F.lit(0)).alias("footers_detected"),
        F.count_if(T.strip("clean_text") == "").alias("empty_pages"),
    ).withColumn("reduction_pct", reduction)
