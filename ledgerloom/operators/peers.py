"""Peer ranking, health score and display series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import numeric as N
from ledgerloom.operators import ratios
from ledgerloom.operators.ordered import rank_within

# Metrics for which a smaller value ranks first.
LOWER_IS_BETTER = ("debt_to_equity", "debt_to_assets", "pe_ratio", "ev_to_ebitda")


def compare_peers(long: DataFrame, group: list[str], position: str) -> DataFrame:
    """Rank of every company in its peer group, per metric.

    ``long`` is the output of ``compute_all``; ``position`` is the input order that
    breaks ties.  Groups may be of any size: ranks come from a range partitioning.
    """
    signed = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    valued = long.where(F.col("value").isNotNull()).withColumn("_signed", signed)
    ranked = rank_within(valued, [*group, "metric"], [F.col("_signed"), F.col(position)])
    return ranked.drop("_signed")


def peer_matrix(long: DataFrame, rows: list[str], company: str, companies: list) -> DataFrame:
    """Metric matrix with one column per named company (or year), a set the caller bounds."""
    return long.groupBy(*rows).pivot(company, companies).agg(F.first("value"))


# The rows of the market comparison, in order.
COMPARED = ("price", "market_cap", "pe_ratio", "forward_pe", "price_to_book", "dividend_yield")


def market_comparison(market: DataFrame, keys: list[str]) -> DataFrame:
    """``metric, value`` of every row of a market table, one row per compared metric; price, value and yield of zero count as missing."""
    def c(name):
        return F.nullif(F.col(name).cast("double"), F.lit(0.0)) if name in ("price", "market_cap", "dividend_yield") else F.col(name).cast("double")

    have = [n for n in COMPARED if n in market.columns]
    return market.select(*keys, *[c(n).alias(n) for n in have]).unpivot(keys, have, "metric", "value")


def _clip(c: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), c))


def _mean(*signals: Column) -> Column:
    known = F.filter(F.array(*signals), lambda s: s.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, s: a + s)
    return F.coalesce(F.try_divide(total, F.size(known)), F.lit(0.0))


def health_score(fin: DataFrame, keys: list[str]) -> DataFrame:
    """Rule-based 0..100 scores per area and their weighted mean."""
    def v(name):
        return ratios.metric_col(name)["value"]

    def signal(c):
        return F.when(c.isNotNull(), _clip(c))

    areas = {
        "profitability": _mean(signal(v("net_margin") * 3), signal(v("roe") * 4), signal(v("roa") * 8)),
        "liquidity": _mean(signal(v("current_ratio") * 50), signal(v("quick_ratio") * 66.7)),
        "solvency": _mean(signal(100 - v("debt_to_equity") * 50), signal(v("interest_coverage") * 10)),
        "cash_flow": _mean(signal(v("cash_conversion")), signal(v("fcf_yield") * 15)),
    }
    scored = fin.select(*keys, *[c.alias(f"_{k}") for k, c in areas.items()])
    # Area weights.
    weights = {"profitability": 0.30, "liquidity": 0.20, "solvency": 0.25, "cash_flow": 0.25}
    overall = sum((F.col(f"_{k}") * w for k, w in weights.items()), F.lit(0.0))
    return scored.select(
        *keys, F.round(overall, 1).alias("overall"),
        *[F.round(f"_{k}", 1).alias(f"{k}_score") for k in areas],
        F.struct(*[F.col(f"_{k}").alias(k) for k in areas]).alias("breakdown"))


def chart_series(fin: DataFrame, company: str = "company", year: str = "year") -> DataFrame:
    """Per company, arrays in year order for the dashboard charts; nulls become 0."""
    def z(name):
        return F.coalesce(F.col(name), F.lit(0.0))

    def base(name):
        return F.coalesce(F.nullif(F.col(name), F.lit(0.0)), F.lit(1.0))

    points = fin.select(
        company, F.col(year).alias("year"), z("revenue").alias("revenue"),
        F.round(z("net_income") / base("revenue") * 100, 2).alias("net_margin"),
        F.round(z("operating_income") / base("revenue") * 100, 2).alias("op_margin"),
        z("operating_cash_flow").alias("operating_cash_flow"),
        (z("operating_cash_flow") - F.abs(z("capital_expenditure"))).alias("free_cash_flow"),
        F.round(z("net_income") / base("total_equity") * 100, 2).alias("roe"))
    names = ("revenue", "net_margin", "op_margin", "operating_cash_flow", "free_cash_flow", "roe")
    g = points.groupBy(company).agg(
        F.array_sort(F.collect_list(F.struct("year", *names))).alias("s"))
    return g.select(company, F.transform("s", lambda x: x["year"].cast("string")).alias("labels"),
                    *[F.col(f"s.{n}").alias(n) for n in names])


def format_metrics(long: DataFrame, keys: list[str]) -> DataFrame:
    """Readable lines per category, and their concatenation per key."""
    line = F.when(
        (F.col("status") == N.COMPUTED) & F.col("value").isNotNull(),
        F.concat(F.lit("    "), "metric", F.lit(": "), N.plain_number("value"), "unit")
    ).otherwise(F.concat(F.lit("    "), "metric", F.lit(": N/A ("), "status", F.lit(")")))
    by_category = (long.withColumn("line", line).groupBy(*keys, "category")
                   .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l")))
    head = F.concat(F.lit("\n  "), F.upper(F.translate("category", "_", " ")), F.lit(":\n"))
    return by_category.select(
        *keys, "category", F.col("l")[0]["pos"].alias("pos"),
        F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def format_metrics_text(long: DataFrame, keys: list[str], category: str | None = None) -> DataFrame:
    """One text per key: the given category when it exists, all of them otherwise."""
    parts = format_metrics(long, keys)
    if category in ratios.CATEGORIES:
        parts = parts.where(F.col("category") == category)
    g = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    return g.select(*keys, F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))
