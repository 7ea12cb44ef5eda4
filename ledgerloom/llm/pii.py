"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Each kind is found leftmost and non-overlapping.  A candidate whose check fails is dropped and not
tried again.  Positions are code points, end exclusive: the text between matches (`split`) and the
matches themselves (`regexp_extract_all`) are added up.  Everything is a row-wise column expression,
so the plan has no shuffle.

The patterns run in time linear in the text: quantifiers are possessive where nothing behind them
could give a character back, and a local part or number starts where a run of its characters starts
or where the match before has ended (\\G), which is where a leftmost match starts anyhow.

Score: 0.4 for the pattern, 0.4 for a confirmed checksum or value range, 0.2 for a context word of
the kind within CONTEXT characters on either side, up to the next match of the kind; 0.2 less if a word that speaks against it stands
there.  The base kinds are never dropped by their score; `iban` spans need their checksum.

Defined results: a null text is an empty one, without spans; empty table, no rows; repeated rows are
handled one by one; further columns stay in `find_spans`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.names import fresh

# Kinds in their order, with the form in which each is searched.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
KINDS = list(PATTERNS)
BASE = KINDS[:4]
# A cheap test that every text with a span of the kind passes.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}"}
CONTEXT = 40
PIECE = 256
BLOCK = 4096
FOR = {"email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|payment",
       "phone": "phone|call|tel|mobile", "iban": "iban|account|bank"}
AGAINST = {"email": "example", "ip": "version|release|section", "card": "isbn|order|serial",
           "phone": "isbn|order|serial", "iban": "serial|licen[cs]e"}
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string,score:double>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn check."""
    n = F.length(digits)

    def term(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def mod97(value: Column) -> Column:
    """True if the account number, first four characters moved to the end, is 1 modulo 97."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest, i):
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 65, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    """The check of a kind."""
    if kind == "ip":
        return value.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(value)
    return F.lit(True)


def _score(kind: str, before: Column, after: Column) -> Column:
    """Score of a confirmed span from the CONTEXT characters before and after it."""
    around = F.lower(F.concat(F.right(before, F.lit(CONTEXT)), F.lit(" "), F.left(after, F.lit(CONTEXT))))
    near = F.when(around.rlike(rf"\b(?:{FOR[kind]})"), 0.2).otherwise(0.0) - F.when(around.rlike(rf"\b(?:{AGAINST[kind]})"), 0.2).otherwise(0.0)
    return F.round(F.lit(0.4 if kind == "email" else 0.8) + near, 1)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """0, then the running fold of whole numbers; in pieces of PIECE, so that no long array is copied per entry."""
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PIECE).cast("int")), lambda p: F.slice(values, p * PIECE + 1, F.lit(PIECE)))
    fold = lambda part, start: F.aggregate(part, start, step)
    bases = F.aggregate(pieces, F.array(F.lit(0)), lambda at, part: F.concat(at, F.array(fold(part, F.element_at(at, -1)))))
    inner = F.transform(pieces, lambda part, p: F.slice(F.aggregate(
        part, F.array(F.get(bases, p)), lambda at, v: F.concat(at, F.array(step(F.element_at(at, -1), v)))), F.lit(2), F.lit(PIECE)))
    return F.when(F.size(values) > 0, F.concat(F.array(F.lit(0)), F.flatten(inner))).otherwise(F.array(F.lit(0)))


def _steps(matches: Column, gaps: Column) -> Column:
    """Characters from the start of the match before, or of the text, to the start of each match."""
    return F.transform(matches, lambda _, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0)))


def _spans(kind: str, rank: int, matches: str, starts: str, before: str, after: str) -> Column:
    """Confirmed spans of a kind.  The arrays are zipped, not looked up, so that each is made once for a text."""
    kept = F.filter(F.arrays_zip(matches, starts, before, after), lambda m: m[matches].isNotNull() & confirmed(kind, m[matches]))
    return F.transform(kept, lambda m: F.struct(
        m[starts].alias("start"), F.lit(rank).alias("rank"), (m[starts] + F.length(m[matches])).alias("end"), F.lit(kind).alias("kind"),
        m[matches].alias("value"), _score(kind, m[before], m[after]).alias("score")))


def find_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """df with an array of spans (start, rank, end, kind, value, score), by start, then kind; out replaces a column of that name."""
    body = fresh(df, "_body")
    name = {(part, kind): fresh(df, f"_{part}_{kind}") for part in ("matches", "gaps", "steps", "starts", "after") for kind in KINDS}
    empty = F.array().cast("array<string>")
    df = df.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    hint = {k: F.col(body).contains("@") if k == "email" else F.col(body).rlike(HINT[k]) for k in KINDS}
    df = df.withColumns({name["matches", k]: F.when(hint[k], F.regexp_extract_all(body, F.lit(p), F.lit(0))).otherwise(empty) for k, p in PATTERNS.items()})
    df = df.withColumns({name["gaps", k]: F.when(F.size(name["matches", k]) > 0, F.split(body, p, -1)).otherwise(empty) for k, p in PATTERNS.items()})
    rest = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    df = df.withColumns({name["steps", k]: _steps(F.col(name["matches", k]), F.col(name["gaps", k])) for k in KINDS})
    df = df.withColumns({name["starts", k]: rest(running(F.col(name["steps", k]), lambda a, b: a + b)) for k in KINDS}
                        | {name["after", k]: rest(F.col(name["gaps", k])) for k in KINDS})
    lists = [F.when(F.size(name["matches", k]) > 0, _spans(k, rank, *(name[part, k] for part in ("matches", "starts", "gaps", "after"))))
             .otherwise(F.array().cast(f"array<{SPAN}>")) for rank, k in enumerate(KINDS)]
    return df.withColumn(out, F.array_sort(F.concat(*lists))).drop(body, *name.values())


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of the spans of the given kinds, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first is named.

    The text is cut into blocks once, and what stands between spans is taken from the blocks it lies in.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / BLOCK).cast("int")), lambda b: F.substring(text, b * BLOCK + 1, F.lit(BLOCK)))
    ends = F.transform(spans, lambda s: s["end"])

    def between(parts, first, last):
        lead = F.floor(first / BLOCK).cast("int")
        near = F.array_join(F.slice(parts, lead + 1, F.floor(last / BLOCK).cast("int") - lead + 1), "")
        return F.substring(near, first - lead * BLOCK + 1, F.greatest(last - first, F.lit(0)))

    def whole(held):
        parts, reach = held["parts"], held["reach"]

        def piece(s, i):
            before = F.get(reach, i)
            name = F.when(s["start"] >= before, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
            return F.concat(between(parts, before, F.greatest(before, s["start"])), name)

        return F.concat(F.array_join(F.transform(spans, piece), ""), between(parts, F.element_at(reach, -1), F.length(text)))

    # One entry, so that blocks and reach are made once for all spans.
    held = F.array(F.struct(blocks.alias("parts"), running(ends, lambda a, b: F.greatest(a, b)).alias("reach")))
    return F.when(F.size(spans) > 0, F.element_at(F.transform(held, whole), 1)).otherwise(text)
