"""Report rows around landed section texts: evidence counts, claims, verdicts, revision, layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators import evidence as E
from ledgerloom.operators import reports as R


@dataclass
class Researched:
    sections: DataFrame
    rollup: DataFrame
    claims: DataFrame
    verification: DataFrame
    revised: DataFrame
    layout: DataFrame


def research_reports(sections: DataFrame, evidence: DataFrame, values: DataFrame, facts: DataFrame,
                     skip_verification: bool = False) -> Researched:
    """``sections``: report_id, section_key, content; ``evidence``: the chunks of each report;
    ``values``: printed values; ``facts``: report_id, has_metrics, has_news."""
    counts = (E.evidence_buckets(evidence).groupBy("report_id", F.col("bucket").alias("section_key"))
              .agg(F.count(F.lit(1)).alias("n")))
    retrieved = evidence.groupBy("report_id").agg(F.count(F.lit(1)).alias("retrieved"))
    rows = R.section_rows(sections.select("report_id", "section_key", "content"), counts, facts.join(retrieved, "report_id", "left"))
    claims = E.extract_claims(sections)
    verified = claims.withColumn("supporting_evidence", F.lit("")) if skip_verification else E.verify_claims(claims, evidence, values)
    body = rows.select("report_id", "section_key", "content", "confidence")
    revised = body if skip_verification else E.revise_report(body, verified)
    return Researched(rows, R.report_rollup(rows), verified, E.verification_summary(sections, verified), revised,
                      R.build_12_sections(revised))
