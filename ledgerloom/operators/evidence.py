"""Evidence formatting, claim extraction and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators.context import source_string
from ledgerloom.session import materialize

# Topic buckets and the substrings that put a chunk in them.
BUCKET_KEYWORDS = {
    "business_overview": ["business", "revenue", "segment", "product", "service", "customer", "market", "industry",
                          "overview", "operations"],
    "risk_analysis": ["risk", "threat", "uncertainty", "litigation", "regulatory", "cybersecurity", "compliance",
                      "adverse", "challenge"],
    "growth_opportunities": ["growth", "opportunity", "expansion", "innovation", "strategy", "invest", "acquisition",
                             "digital", "transform", "AI", "artificial intelligence", "new market"],
    "financial_analysis": ["revenue", "income", "margin", "profit", "cash flow", "earnings", "financial",
                           "balance sheet", "debt"],
}

# Report sections in reading order and words that mark a claim.
SECTION_ORDER = ("executive_summary", "business_overview", "financial_analysis", "risk_analysis",
                 "growth_opportunities", "valuation", "investment_thesis")
METRIC_KEYWORDS = ("revenue", "margin", "profit", "income", "growth", "ratio", "yield", "earnings", "ebitda", "debt",
                   "equity", "assets", "cash", "dividend", "roe", "roa", "roic", "p/e", "pe", "ev", "market cap",
                   "turnover", "billion", "million", "trillion", "crore", "lakh")


def evidence_buckets(chunks: DataFrame) -> DataFrame:
    """One row per chunk and bucket; a chunk that fits none goes to ``other``."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("section", F.lit(""))))
    hits = F.array_compact(F.array(*[
        F.when(T.any_keyword(hay, words), name) for name, words in BUCKET_KEYWORDS.items()]))
    buckets = F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("other")))
    return chunks.withColumn("bucket", F.explode(buckets))


def section_confidence(has_metrics: Column, evidence_count: Column, has_news: Column) -> Column:
    score = (F.when(has_metrics, 0.5).otherwise(0.0)
             + F.when(evidence_count >= 3, 0.35).when(evidence_count >= 1, 0.20).otherwise(0.0)
             + F.when(has_news, 0.15).otherwise(0.0))
    return F.least(F.lit(1.0), F.round(score, 2))


def format_evidence(chunks: DataFrame, key: str = "request_id", order: str = "pos", width: int | None = None) -> DataFrame:
    """Numbered references of each request's chunks (a retrieval result, so few) as one text.

    ``width`` cuts each chunk to so many characters; without it chunks stay whole.
    """
    body = T.strip("text")
    source = source_string(fields=("section",))
    row = F.struct(F.col(order).alias("at"), source.alias("source"), F.coalesce("score", F.lit(0.0)).alias("score"),
                   (body if width is None else F.substring(body, 1, width)).alias("body"))
    g = chunks.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lines = F.transform("rows", lambda x, i: F.concat(
        F.format_string("  [%d] (", i + 1), x["source"], F.lit(", relevance: "), F.format_string("%.2f", x["score"]),
        F.lit(")\n      "), x["body"], F.lit("\n")))
    return g.select(key, F.array_join(lines, "\n").alias("text"))


def format_news(news: DataFrame, key: str = "request_id", order: str = "pos", limit: int | None = None,
                width: int | None = None) -> DataFrame:
    """News items of each key as a list: the first ``limit`` with summaries of ``width`` characters, or all and whole."""
    from ledgerloom.operators.ordered import top_per_key
    first = top_per_key(news, [key], [F.col(order)], limit, "_rn")
    summary = F.coalesce("summary", F.lit(""))
    summary = summary if width is None else F.substring(summary, 1, width)
    line = F.concat(F.lit("  - "), F.coalesce("title", F.lit("Untitled")), F.lit(" ("), F.coalesce("date", F.lit("")), F.lit(")"),
                    F.when(summary != "", F.concat(F.lit("\n    "), summary)).otherwise(""))
    g = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_rn"), line.alias("line")))).alias("l"))
    return g.select(key, F.array_join(F.col("l.line"), "\n").alias("text"))


def split_sentences(c) -> Column:
    """Sentences of a text without bold and italic marks, blank ones dropped."""
    plain = F.regexp_replace(F.regexp_replace(T.col(c), r"\*\*([^*]+)\*\*", "$1"), r"\*([^*]+)\*", "$1")
    pieces = F.split(plain, r"(?U)(?<=[.!?])\s+(?=[A-Z])", -1)
    lines = F.flatten(F.transform(pieces, lambda s: F.split(s, "\n+", -1)))
    return F.filter(F.transform(lines, T.strip), lambda s: s != "")


def extract_claims(sections: DataFrame) -> DataFrame:
    """Sentences with a number or a metric word: ``report_id, section, pos, text, flags``."""
    order = F.array_position(F.array(*[F.lit(s) for s in SECTION_ORDER]), F.col("section_key")).cast("int")
    s = (sections.where(F.col("section_key").isin(*SECTION_ORDER) & (F.coalesce("content", F.lit("")) != ""))
         .select("report_id", F.col("section_key").alias("section"), order.alias("section_no"),
                 F.posexplode(split_sentences("content")).alias("pos", "text")))
    number = F.col("text").rlike(r"(?U)\d")
    keyword = T.any_keyword(F.lower("text"), METRIC_KEYWORDS)
    return (s.where((F.length("text") >= 15) & (number | keyword))
            .withColumns({"has_number": number, "has_citation": F.col("text").rlike(r"(?U)\[\d+\]"),
                          "verification": F.lit("pending")}))


def number_tokens(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(T.col(c), F.lit(r"(?U)\d+\.?\d*"), F.lit(0)))


def long_words(c) -> Column:
    return F.array_distinct(F.filter(F.split(T.strip(F.lower(T.col(c))), r"(?U)\s+"), lambda w: F.length(w) > 3))


CLAIM_KEY = ["report_id", "section_no", "pos"]


def claim_evidence_join(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """First chunk in order (``pos``, unique in a report) that shares a number or three longer words with a claim.

    Tokens meet by an equality join on report and token, so a report with very many chunks is spread by its
    tokens.  Of a number only the first chunk counts.  A chunk that shares three of the claim's w words has one of the
    w - 2 that are rarest in the report's evidence, so only these are looked up; what they find before the
    first number is checked on all words.  Adds ``chunk_snippet`` (null without support).
    """
    # Written with all columns, so that the sentences are not split again for the last join.
    said = materialize(claims.select("*", number_tokens("text").alias("_numbers"), long_words("text").alias("_words")), "claims")
    columns, said = claims.columns, said.withColumnsRenamed({"_numbers": "numbers", "_words": "words"})
    chunks = materialize(evidence.select("report_id", F.col("pos").alias("at"), number_tokens("text").alias("numbers"), long_words("text").alias("words")), "tokens")
    token = ["report_id", "token"]

    first = chunks.select("report_id", "at", F.explode("numbers").alias("token")).groupBy(*token).agg(F.min("at").alias("at"))
    by_number = said.select(*CLAIM_KEY, F.explode("numbers").alias("token")).join(first, token).groupBy(*CLAIM_KEY).agg(F.min("at").alias("before"))

    postings = chunks.select("report_id", "at", F.explode("words").alias("token"))
    spread = postings.groupBy(*token).agg(F.count(F.lit(1)).alias("n"))
    known = (said.select(*CLAIM_KEY, F.explode("words").alias("token")).join(spread, token).groupBy(*CLAIM_KEY)
             .agg(F.array_sort(F.collect_list(F.struct("n", "token")))["token"].alias("known")).where(F.size("known") >= 3))
    asked = known.join(by_number, CLAIM_KEY, "left").select("*", F.explode(F.slice("known", F.lit(1), F.size("known") - 2)).alias("token"))
    tried = (asked.join(postings, token).where(F.col("before").isNull() | (F.col("at") < F.col("before")))
             .groupBy(*CLAIM_KEY, "at").agg(F.first("known").alias("known")))
    met = tried.join(chunks.select("report_id", "at", "words"), ["report_id", "at"]).where(F.size(F.array_intersect("known", "words")) >= 3)

    best = (met.select(*CLAIM_KEY, "at").unionByName(by_number.withColumnRenamed("before", "at"))
            .groupBy(*CLAIM_KEY).agg(F.min("at").alias("at")))
    snippets = evidence.select("report_id", F.col("pos").alias("at"), F.substring("text", 1, 200).alias("chunk_snippet"))
    supported = best.join(snippets, ["report_id", "at"]).drop("at")
    return said.select(*columns).join(supported, CLAIM_KEY, "left").select(*columns, "chunk_snippet")


def claim_metric_match(claims: DataFrame, values: DataFrame) -> DataFrame:
    """First known value of the report whose printed form occurs in the claim.

    ``values`` has ``report_id, value_pos, printed, label``: a fixed catalogue of
    metrics, then market fields, so one short array per report.
    """
    g = values.where(F.col("printed").isNotNull()).groupBy("report_id").agg(
        F.array_sort(F.collect_list(F.struct("value_pos", "printed", "label"))).alias("known"))
    joined = claims.join(g, "report_id", "left")
    hit = F.filter("known", lambda v: F.contains(F.col("text"), v["printed"]))
    return joined.withColumn("metric_match", F.try_element_at(hit, F.lit(1))["label"]).drop("known")


def verify_claims(claims: DataFrame, evidence: DataFrame, values: DataFrame) -> DataFrame:
    """Verdict per claim with its support."""
    matched = claim_metric_match(claim_evidence_join(claims, evidence), values)
    support = F.coalesce(T.truthy("chunk_snippet"), T.truthy("metric_match"))
    return matched.withColumns({
        "verification": F.when(support.isNotNull() | F.col("has_citation") | ~F.col("has_number"), "verified")
        .otherwise("unverified"),
        "supporting_evidence": F.when(support.isNotNull(), support)
        .when(F.col("has_citation"), "Citation present (reference verified)")
        .when(~F.col("has_number"), "Qualitative observation").otherwise("")}).drop("chunk_snippet", "metric_match")


def verification_summary(reports: DataFrame, verified: DataFrame) -> DataFrame:
    """Counts and rate per report; a report without claims has rate 1."""
    g = verified.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("total_claims"), F.count_if(F.col("verification") == "verified").alias("verified"),
        F.count_if(F.col("verification") == "unverified").alias("unverified"))
    out = reports.select("report_id").distinct().join(g, "report_id", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "report_id", *[F.coalesce(c, zero).alias(c) for c in ("total_claims", "verified", "unverified")],
        zero.alias("revised"), zero.alias("removed"),
        F.coalesce(F.round(F.try_divide("verified", "total_claims"), 2), F.lit(1.0)).alias("verification_rate"))


def revise_report(sections: DataFrame, verified: DataFrame) -> DataFrame:
    """Sections with a disclaimer and lower confidence where claims stayed unverified."""
    bad = (verified.where(F.col("verification") == "unverified")
           .groupBy("report_id", F.col("section").alias("section_key")).agg(F.count(F.lit(1)).alias("n_unverified")))
    # One row per report and section: the totals of a report are a window over few rows, so the verdicts are taken once.
    whole = Window.partitionBy("report_id")
    bad = bad.withColumns({"_claims": F.sum("n_unverified").over(whole), "_sections": F.count(F.lit(1)).over(whole)})
    totals = sections.join(bad, ["report_id", "section_key"], "left")
    out = totals.withColumns({c: F.max(c).over(whole) for c in ("_claims", "_sections")})
    # Fixed value: the wording of the disclaimer.
    disclaimer = F.concat(
        F.lit("\n\n*Note: "), "n_unverified",
        F.lit(" statement(s) in this section could not be fully verified against the available evidence. "
              "Readers should cross-reference with primary sources.*"))
    lowered = F.round(F.greatest(F.lit(0.1), F.coalesce("confidence", F.lit(0.5)) - 0.1 * F.col("n_unverified")), 2)
    return out.withColumns({
        "content": F.when(F.col("n_unverified").isNotNull(), F.concat("content", disclaimer)).otherwise(F.col("content")),
        "confidence": F.when(F.col("n_unverified").isNotNull(), lowered).otherwise(F.col("confidence")),
        "revision_notes": F.when(F.col("_claims").isNull(), "All claims verified — no revision needed.").otherwise(
            F.concat("_claims", F.lit(" claims revised across "), "_sections", F.lit(" sections.")))}
    ).drop("_claims", "_sections")
