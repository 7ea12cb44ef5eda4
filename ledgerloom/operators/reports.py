"""Report assembly, layout, export texts and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.operators.context import source_string
from ledgerloom.operators.evidence import section_confidence
from ledgerloom.operators.ordered import last_per_key, rank_within

# Report layout (id, title, source section or null, fixed text, attached data).
LAYOUT = (
    (1, "Executive Summary", "executive_summary", None, None),
    (2, "Investment Thesis", "investment_thesis", None, None),
    (3, "Company Overview", "business_overview", None, None),
    (4, "Financial Performance", "financial_analysis", None, "revenue_trend"),
    (5, "Financial Ratio Dashboard", None, "Key performance indicators and financial health metrics.", "metrics"),
    (6, "Growth Analysis", "growth_opportunities", None, None),
    (7, "Competitive Analysis", None, "Peer comparison and competitive positioning in the sector.", None),
    (8, "Risk Analysis", "risk_analysis", None, None),
    (9, "Recent News Impact", None, "Analysis of recent events and news items.", "news"),
    (10, "Valuation Commentary", "valuation", None, None),
    (11, "Sources", None, "References and citations used to compile this report.", "citations"),
    (12, "Appendix", None, "Raw financial data and methodology.", "raw_financials"),
)


def section_rows(sections: DataFrame, bucket_counts: DataFrame, report_facts: DataFrame) -> DataFrame:
    """Evidence count and confidence of every generated section.

    ``bucket_counts``: report_id, section_key, n; ``report_facts``: report_id,
    has_metrics, has_news, retrieved.  An empty bucket counts all retrieved chunks.
    """
    joined = (sections.join(bucket_counts, ["report_id", "section_key"], "left").join(report_facts, "report_id", "left"))
    count = F.coalesce(F.nullif("n", F.lit(0)), "retrieved", F.lit(0))
    ok = F.col("content").isNotNull()
    conf = section_confidence(F.coalesce("has_metrics", F.lit(False)), count, F.coalesce("has_news", F.lit(False)))
    return joined.select(
        "report_id", "section_key", F.initcap(F.replace("section_key", F.lit("_"), F.lit(" "))).alias("title"), "content",
        F.when(ok, conf).otherwise(F.lit(0.0)).alias("confidence"), F.when(ok, count).otherwise(F.lit(0)).alias("evidence_count"),
        ok.alias("generated"))


def report_rollup(rows: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Per report: sections generated and failed, and the mean confidence of the generated ones.

    With ``chunks`` (report_id, pos, chunk_id and the fields of a source) also ``citations``: position,
    source string and chunk of everything retrieved for the report, in order.
    """
    # Confidences have two decimals; whole hundredths make the mean independent of row order.
    hundredths = F.when(F.col("generated"), F.round(F.col("confidence") * 100).cast("long"))
    mean = F.try_divide(F.sum(hundredths), F.count(hundredths)) / 100
    out = rows.groupBy("report_id").agg(
        F.count_if("generated").alias("sections_generated"), F.count_if(~F.col("generated")).alias("sections_failed"),
        F.sum("evidence_count").alias("evidence_total"),
        F.coalesce(F.round(mean, 2), F.lit(0.0)).alias("overall_confidence"))
    if chunks is None:
        return out
    cited = F.struct("pos", source_string(fields=("section",)).alias("source"), "chunk_id")
    return out.join(chunks.groupBy("report_id").agg(F.array_sort(F.collect_list(cited)).alias("citations")), "report_id", "left")


def layout(spark) -> DataFrame:
    return spark.createDataFrame(
        list(LAYOUT), "id int, title string, section_key string, fixed_text string, data_key string")


def build_12_sections(sections: DataFrame, attached: DataFrame | None = None) -> DataFrame:
    """Twelve rows per report; a section the report lacks is empty with confidence 0.

    The layout is an array literal, so every report is expanded in place.
    ``attached`` (report_id, data_key, data) adds the data shown with a section.
    """
    slots = F.array(*[F.struct(
        F.lit(i).alias("id"), F.lit(title).alias("title"), F.lit(key).cast("string").alias("section_key"),
        F.lit(text).cast("string").alias("fixed_text"), F.lit(data).cast("string").alias("data_key"))
        for i, title, key, text, data in LAYOUT])
    wide = sections.select("report_id").distinct().select("report_id", F.inline(slots))
    body = sections.select("report_id", "section_key", "content", "confidence")
    out = wide.join(body, ["report_id", "section_key"], "left")
    if attached is not None:
        out = out.join(attached, ["report_id", "data_key"], "left")
    else:
        out = out.withColumn("data", F.lit(None).cast("string"))
    own = F.col("section_key").isNotNull()
    return out.select(
        "report_id", "id", "title", F.coalesce("fixed_text", "content", F.lit("")).alias("content"),
        F.when(own, F.coalesce("confidence", F.lit(0.0))).alias("confidence"), "data_key", "data")


def report_markdown(layout_rows: DataFrame, reports: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """Markdown text per report; ``citations`` are (report_id, ref, source, text_preview)."""
    piece = F.concat(F.lit("## "), "title", F.lit("\n\n"),
                     F.when(F.col("content") != "", F.concat("content", F.lit("\n\n"))).otherwise(""))
    if citations is not None:
        line = F.concat("ref", F.lit(". **"), F.coalesce("source", F.lit("Unknown")), F.lit("**: "),
                        F.coalesce("text_preview", F.lit("")), F.lit("\n"))
        listed = citations.groupBy("report_id").agg(
            F.array_sort(F.collect_list(F.struct("ref", line.alias("line")))).alias("c"))
        listed = listed.select("report_id", F.concat(F.array_join(F.col("c.line"), ""), F.lit("\n")).alias("_sources"))
        layout_rows = layout_rows.join(listed, "report_id", "left")
        piece = F.concat(piece, F.when(F.col("title") == "Sources", F.coalesce("_sources", F.lit("\n"))).otherwise(""))
    g = layout_rows.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("id", piece.alias("text")))).alias("s"))
    head = F.concat(
        F.lit("# Equity Research Report: "), F.coalesce("company", F.lit("Company")), F.lit(" ("),
        F.coalesce("ticker", F.lit("TICKER")), F.lit(")\n\n**Generated At:** "), F.coalesce("generated_at", F.lit("")),
        F.lit("\n\n---\n\n"))
    return (g.join(reports, "report_id", "left")
            .select("report_id", F.concat(head, F.array_join(F.col("s.text"), "")).alias("markdown")))


def report_json(layout_rows: DataFrame, reports: DataFrame) -> DataFrame:
    """One JSON document per report: metadata and the sections in order."""
    g = layout_rows.groupBy("report_id").agg(F.array_sort(F.collect_list(
        F.struct("id", "title", "content", "confidence"))).alias("sections"))
    return (g.join(reports, "report_id", "left").select(
        "report_id", F.to_json(F.struct(F.struct("company", "ticker", "generated_at").alias("metadata"), "sections")).alias("report_json")))


def next_versions(existing: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """Version numbers of a batch of new reports: count so far plus the place in the batch."""
    keys = ["user", "ticker"]
    have = existing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
    placed = rank_within(new, keys, order, "_place")
    return (placed.join(have, keys, "left")
            .withColumn("version", (F.coalesce("_have", F.lit(0)) + F.col("_place")).cast("long")).drop("_have", "_place"))


def latest_report(versions: DataFrame) -> DataFrame:
    return last_per_key(versions, ["user", "ticker"], [F.col("version")])


def report_versions(versions: DataFrame, user, ticker: str) -> DataFrame:
    """Versions of one user and ticker, newest first."""
    return (versions.where((F.col("user") == user) & (F.col("ticker") == ticker.upper()))
            .orderBy(F.desc("version")).select("version", "created_at", "report_id"))
