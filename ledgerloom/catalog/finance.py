"""Queries over company financials."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ledgerloom.catalog.bindings import FIN_SQL, financials
from ledgerloom.catalog.registry import query
from ledgerloom.operators import growth, peers, ratios
from ledgerloom.operators.ordered import last_per_key

KEYS = ["company", "year"]

# Numerator, denominator and factor of each metric, stated separately from the
# column builders so that the check is independent of them.
CASH = "(operating_cash_flow - coalesce(abs(capital_expenditure), 0))"
EV = "(market_cap + coalesce(total_debt, 0) - coalesce(cash_and_equivalents, 0))"
ROIC_RATE = ("CASE WHEN pretax_income <> 0 AND tax_provision <> 0 THEN tax_provision / pretax_income "
             "WHEN net_income IS NOT NULL AND operating_income <> 0 THEN greatest(0, 1 - net_income / operating_income) "
             "ELSE 0.25::DOUBLE END")
SQL_METRICS = {
    "gross_margin": ("gross_profit", "revenue", 100), "operating_margin": ("operating_income", "revenue", 100),
    "net_margin": ("net_income", "revenue", 100), "ebitda_margin": ("ebitda", "revenue", 100),
    "roe": ("net_income", "total_equity", 100), "roa": ("net_income", "total_assets", 100),
    "roic": (f"(operating_income * (1 - ({ROIC_RATE})))",
             "(total_equity + total_debt - coalesce(cash_and_equivalents, 0))", 100),
    "current_ratio": ("current_assets", "current_liabilities", 1),
    "quick_ratio": ("(current_assets - coalesce(inventory, 0))", "current_liabilities", 1),
    "cash_ratio": ("cash_and_equivalents", "current_liabilities", 1),
    "debt_to_equity": ("total_debt", "total_equity", 1), "debt_to_assets": ("total_debt", "total_assets", 1),
    "interest_coverage": ("operating_income", "interest_expense", 1),
    "equity_multiplier": ("total_assets", "total_equity", 1),
    "free_cash_flow": (CASH, None, 1), "ocf_ratio": ("operating_cash_flow", "net_income", 1),
    "capex_to_revenue": ("abs(capital_expenditure)", "revenue", 100),
    "cash_conversion": (CASH, "net_income", 100), "fcf_yield": (CASH, "market_cap", 100),
    "asset_turnover": ("revenue", "total_assets", 1), "inventory_turnover": ("cost_of_revenue", "inventory", 1),
    "receivables_turnover": ("revenue", "accounts_receivable", 1),
    "working_capital_turnover": ("revenue", "(current_assets - current_liabilities)", 1),
    "payables_turnover": ("cost_of_revenue", "accounts_payable", 1),
    "pe_ratio": ("share_price", "eps", 1), "ev_to_ebitda": (f"coalesce(enterprise_value, {EV})", "ebitda", 1),
    "price_to_book": ("market_cap", "total_equity", 1), "enterprise_value": (EV, None, 1),
    "dividend_yield": ("dividend_per_share", "share_price", 100), "price_to_sales": ("market_cap", "revenue", 1),
}


def round_sql(e: str, places: int) -> str:
    """``e`` rounded half away from zero by the digits it is written with, as Spark does.

    DuckDB's round() of a double multiplies first, and the product may become a tie that the number is not.
    A number without room in the decimal has no places to round.
    """
    digits = f"TRY_CAST(CAST({e} AS VARCHAR) AS DECIMAL(38, 20))"
    return f"coalesce(CAST(CAST(round({digits}, {places}) AS VARCHAR) AS DOUBLE), {e})"


def metric_value_sql(name: str, rounded=lambda e, places: f"round({e}, {places})") -> str:
    num, den, mult = SQL_METRICS[name]
    if den is None:
        return rounded(num, 4)
    return f"CASE WHEN {den} <> 0 THEN {rounded(f'{num} / {den} * {mult}::DOUBLE', 4)} END"


def metric_status_sql(name: str) -> str:
    num, den, _ = SQL_METRICS[name]
    if den is None:
        return f"CASE WHEN {num} IS NULL THEN 'missing_data' ELSE 'computed' END"
    return (f"CASE WHEN {num} IS NULL OR {den} IS NULL THEN 'missing_data' "
            f"WHEN {den} = 0 THEN 'division_by_zero' ELSE 'computed' END")


def _single(name):
    m = ratios.BY_NAME[name]
    sql = (f"WITH {FIN_SQL} SELECT company, year, {metric_value_sql(name)} AS value, '{m.unit}' AS unit, "
           f"{metric_status_sql(name)} AS status FROM fin")

    @query(name, sql)
    def run(spark, folder):
        return ratios.single_metric(financials(spark, folder), name, KEYS).select(*KEYS, "value", "unit", "status")


for _m in ratios.METRICS:
    _single(_m.name)

LONG_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT company, year, peer_group, '{m.category}' AS category, {i} AS pos, '{m.name}' AS metric, "
    f"{metric_value_sql(m.name)} AS value, '{m.unit}' AS unit, {metric_status_sql(m.name)} AS status FROM fin"
    for i, m in enumerate(ratios.METRICS)) + ")"

PREV_SQL = """prev AS (SELECT *, lag(year) OVER w AS prev_year, lag(revenue) OVER w AS prev_revenue,
  lag(net_income) OVER w AS prev_net_income, lag(eps) OVER w AS prev_eps, lag(ebitda) OVER w AS prev_ebitda,
  lag(operating_income) OVER w AS prev_operating_income FROM fin WINDOW w AS (PARTITION BY company ORDER BY year))"""


def growth_value_sql(c: str) -> str:
    return f"CASE WHEN prev_{c} <> 0 THEN round(({c} - prev_{c}) / abs(prev_{c}) * 100::DOUBLE, 4) END"


def growth_status_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR prev_{c} IS NULL THEN 'missing_data' WHEN prev_{c} = 0 "
            "THEN 'division_by_zero' ELSE 'computed' END")


def _growth(name, c, label):
    sql = (f"WITH {FIN_SQL}, {PREV_SQL} SELECT company, year, {growth_value_sql(c)} AS value, "
           f"{growth_status_sql(c)} AS status FROM prev")

    @query(name, sql)
    def run(spark, folder):
        both = growth.with_previous(financials(spark, folder))
        return (both.select(*KEYS, growth.yoy(F.col(c), F.col(f"prev_{c}"), label).alias("m"))
                .select(*KEYS, "m.value", "m.status"))


for _g in growth.GROWTH:
    _growth(*_g)


@query("peg_ratio", f"""WITH {FIN_SQL}, {PREV_SQL}, g AS (SELECT *, {growth_value_sql('eps')} AS growth FROM prev)
SELECT company, year, CASE WHEN eps <> 0 AND growth <> 0 THEN round(share_price / eps / growth, 4) END AS value,
 CASE WHEN share_price IS NOT NULL AND eps <> 0 AND growth <> 0 THEN 'computed' ELSE 'missing_data' END AS status FROM g""")
def peg(spark, folder):
    both = growth.with_previous(financials(spark, folder))
    rate = growth.yoy(F.col("eps"), F.col("prev_eps"), "EPS")["value"]
    return (both.select(*KEYS, ratios.peg_ratio(F.col("share_price"), F.col("eps"), rate).alias("m"))
            .select(*KEYS, "m.value", "m.status"))


CAGR_SQL = """CASE WHEN {s} > 0 AND {n} > 0 AND NOT ({e} < 0 AND {n} > 1)
 THEN round((pow({e} / {s}, 1 / CAST({n} AS DOUBLE)) - 1) * 100, 4) END"""
CAGR_STATUS_SQL = """CASE WHEN {s} IS NULL OR {e} IS NULL OR {n} <= 0 THEN 'missing_data' WHEN {s} <= 0 THEN 'division_by_zero'
 WHEN {e} < 0 AND {n} > 1 THEN 'anomaly' ELSE 'computed' END"""


@query("cagr", f"""WITH {FIN_SQL}, ends AS (SELECT company, min_by(net_income, year) AS s, max_by(net_income, year) AS e,
  count(*) - 1 AS n FROM fin GROUP BY company)
SELECT company, {CAGR_SQL.format(s='s', e='e', n='n')} AS value, {CAGR_STATUS_SQL.format(s='s', e='e', n='n')} AS status FROM ends""")
def cagr(spark, folder):
    ends = financials(spark, folder).groupBy("company").agg(
        F.min_by("net_income", "year").alias("s"), F.max_by("net_income", "year").alias("e"),
        (F.count(F.lit(1)) - 1).alias("n"))
    return (ends.select("company", growth.cagr(F.col("s"), F.col("e"), F.col("n")).alias("m"))
            .select("company", "m.value", "m.status"))


@query("compute_all", f"""WITH {FIN_SQL}, {LONG_SQL} SELECT company, year, category, metric, value, unit, status FROM long""")
def compute_all(spark, folder):
    return ratios.compute_all(financials(spark, folder), KEYS).drop("pos", "formula")


@query("metric_summary", f"""WITH {FIN_SQL}, {LONG_SQL} SELECT peer_group,
 count(*) FILTER (status = 'computed') AS computed, count(*) FILTER (status = 'missing_data') AS missing,
 count(*) FILTER (status NOT IN ('computed', 'missing_data')) AS errors, count(*) AS total
 FROM long GROUP BY peer_group""")
def metric_summary(spark, folder):
    return ratios.metric_summary(
        ratios.compute_all(financials(spark, folder), ["company", "year", "peer_group"]), ["peer_group"])


@query("compute_growth", f"WITH {FIN_SQL}, {PREV_SQL} " + " UNION ALL ".join(
    f"SELECT company, year, '{n}' AS metric, {growth_value_sql(c)} AS value, '%' AS unit, {growth_status_sql(c)} AS status "
    "FROM prev WHERE prev_year IS NOT NULL" for n, c, _ in growth.GROWTH))
def compute_growth(spark, folder):
    return growth.compute_growth(financials(spark, folder), KEYS).drop("formula")


def _yoy_sql(c):
    return f"CASE WHEN {c} IS NOT NULL AND prev_{c} <> 0 THEN round(({c} - prev_{c}) / abs(prev_{c}) * 100::DOUBLE, 4) END"


@query("compute_trends", f"""WITH {FIN_SQL}, {PREV_SQL}, t AS (
 SELECT company, count(*) - 1 AS n_years, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years,
  string_agg(CAST(CAST(round(revenue * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY year) AS revenue_cents,
  min_by(revenue, year) AS r0, max_by(revenue, year) AS r1, min_by(net_income, year) AS i0, max_by(net_income, year) AS i1,
  CAST(coalesce(sum(CAST(round({_yoy_sql('revenue')} * 10000) AS BIGINT)), 0) AS BIGINT) AS revenue_growth_total FROM prev GROUP BY company)
SELECT company, n_years, years, revenue_cents,
 CASE WHEN r0 <> 0 AND r1 <> 0 THEN {CAGR_SQL.format(s='r0', e='r1', n='n_years')} END AS revenue_cagr,
 CASE WHEN i0 > 0 AND i1 <> 0 THEN {CAGR_SQL.format(s='i0', e='i1', n='n_years')} END AS net_income_cagr,
 CASE WHEN i0 > 0 AND i1 <> 0 THEN {CAGR_STATUS_SQL.format(s='i0', e='i1', n='n_years')} END AS net_income_status,
 revenue_growth_total FROM t WHERE n_years >= 1""")
def compute_trends(spark, folder):
    t = growth.compute_trends(financials(spark, folder)).where(F.col("error").isNull())
    return t.select(
        "company", "n_years",
        F.array_join(F.transform("series", lambda x: x["year"].cast("string")), ",").alias("years"),
        F.array_join(F.transform("series", lambda x: F.round(x["revenue"] * 100).cast("long").cast("string")), ",").alias("revenue_cents"),
        F.col("revenue_cagr.value").alias("revenue_cagr"), F.col("net_income_cagr.value").alias("net_income_cagr"),
        F.col("net_income_cagr.status").alias("net_income_status"),
        F.aggregate("yoy_growth", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.round(x["revenue_growth"] * 10000).cast("long"), F.lit(0)))
        .alias("revenue_growth_total"))


RANK_SQL = """CASE WHEN metric IN ('debt_to_equity', 'debt_to_assets', 'pe_ratio', 'ev_to_ebitda') THEN value ELSE -value END"""


@query("compare_peers", f"""WITH {FIN_SQL}, {LONG_SQL} SELECT company, year, peer_group, metric, value,
 CAST(row_number() OVER (PARTITION BY peer_group, year, metric ORDER BY {RANK_SQL}, company) AS BIGINT) AS rank
 FROM long WHERE value IS NOT NULL""")
def compare_peers(spark, folder):
    long = ratios.compute_all(financials(spark, folder), ["company", "year", "peer_group"])
    return (peers.compare_peers(long, ["peer_group", "year"], "company")
            .select("company", "year", "peer_group", "metric", "value", "rank"))


def _clip_sql(e):
    return f"CASE WHEN {e} IS NOT NULL THEN least(100::DOUBLE, greatest(0::DOUBLE, {e})) END"


def _mean_sql(*es):
    terms = [_clip_sql(e) for e in es]
    total = "0::DOUBLE" + "".join(f" + coalesce({t}, 0)" for t in terms)
    n = " + ".join(f"CASE WHEN {e} IS NULL THEN 0 ELSE 1 END" for e in es)
    return f"CASE WHEN {n} = 0 THEN 0::DOUBLE ELSE ({total}) / ({n}) END"


HEALTH_SQL = f"""m AS (SELECT company, year, {', '.join(f'{metric_value_sql(n, round_sql)} AS m_{n}' for n in
  ('net_margin', 'roe', 'roa', 'current_ratio', 'quick_ratio', 'debt_to_equity', 'interest_coverage', 'cash_conversion', 'fcf_yield'))} FROM fin),
h AS (SELECT company, year,
 {_mean_sql('m_net_margin * 3', 'm_roe * 4', 'm_roa * 8')} AS p, {_mean_sql('m_current_ratio * 50', 'm_quick_ratio * 66.7::DOUBLE')} AS l,
 {_mean_sql('100 - m_debt_to_equity * 50', 'm_interest_coverage * 10')} AS s, {_mean_sql('m_cash_conversion', 'm_fcf_yield * 15')} AS c FROM m)"""


@query("financial_health_score", f"""WITH {FIN_SQL}, {HEALTH_SQL}
SELECT company, year, {round_sql('(0::DOUBLE + p * 0.30::DOUBLE + l * 0.20::DOUBLE + s * 0.25::DOUBLE + c * 0.25::DOUBLE)', 1)} AS overall,
 {round_sql('p', 1)} AS profitability_score, {round_sql('l', 1)} AS liquidity_score, {round_sql('s', 1)} AS solvency_score, {round_sql('c', 1)} AS cash_flow_score FROM h""")
def financial_health_score(spark, folder):
    return peers.health_score(financials(spark, folder), KEYS).drop("breakdown")


@query("formula_registry", f"""WITH {FIN_SQL}, {LONG_SQL} SELECT category, metric, unit,
 count(*) FILTER (status = 'computed') AS computed, count(*) AS total FROM long GROUP BY ALL
UNION ALL SELECT c, m, u, 0, 0 FROM (VALUES ('growth', 'revenue_growth', '%'), ('growth', 'net_income_growth', '%'), ('growth', 'eps_growth', '%'),
 ('growth', 'ebitda_growth', '%'), ('growth', 'cagr', '%'), ('valuation', 'peg_ratio', 'x')) v(c, m, u)""")
def formula_registry(spark, folder):
    long = ratios.compute_all(financials(spark, folder), KEYS)
    counts = long.groupBy("metric").agg(F.count_if(F.col("status") == "computed").alias("computed"),
                                        F.count(F.lit(1)).alias("total"))
    # Growth, CAGR and PEG need more than one year; their rows have no counts here.
    return (ratios.formula_registry(spark).join(counts, "metric", "left")
            .select("category", "metric", "unit", F.coalesce("computed", F.lit(0)).alias("computed"), F.coalesce("total", F.lit(0)).alias("total")))


# Whole hundredths, so that a total does not depend on the order of its terms.
_HUNDREDTHS = "CAST(sum(CAST(round({} * 100) AS BIGINT)) AS BIGINT)"


_SERIES = ("revenue", "net_margin", "op_margin", "operating_cash_flow", "free_cash_flow", "roe")


def _margin_sql(part: str, whole: str) -> str:
    return round_sql(f"(coalesce({part}, 0) / coalesce(nullif({whole}, 0), 1) * 100)", 2)


@query("chart_series", f"""WITH {FIN_SQL}, pts AS (SELECT company, year, coalesce(revenue, 0) AS revenue,
 {_margin_sql('net_income', 'revenue')} AS net_margin, {_margin_sql('operating_income', 'revenue')} AS op_margin, {_margin_sql('net_income', 'total_equity')} AS roe,
 coalesce(operating_cash_flow, 0) AS operating_cash_flow, coalesce(operating_cash_flow, 0) - abs(coalesce(capital_expenditure, 0)) AS free_cash_flow FROM fin)
SELECT company, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS labels,
 {', '.join(f"string_agg(CAST(CAST(round({s} * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY year) AS {s}" for s in _SERIES)},
 {', '.join(f"{_HUNDREDTHS.format(s)} AS {s}_total" for s in _SERIES)}, max_by(net_margin, year) AS last_net_margin FROM pts GROUP BY company""")
def chart_series(spark, folder):
    """Every point of all six series, in whole hundredths, and their totals."""
    s = peers.chart_series(financials(spark, folder))

    def hundredths(name):
        return F.transform(name, lambda v: F.round(v * 100).cast("long"))

    def total(name):
        return F.aggregate(hundredths(name), F.lit(0).cast("long"), lambda a, v: a + v).alias(f"{name}_total")

    return s.select("company", F.array_join("labels", ",").alias("labels"), *[F.array_join(hundredths(n), ",").alias(n) for n in _SERIES],
                    *[total(n) for n in _SERIES], F.element_at("net_margin", -1).alias("last_net_margin"))


@query("format_metrics", f"""WITH {FIN_SQL}, {LONG_SQL}, lines AS (SELECT company, year, category, pos,
 CASE WHEN status = 'computed' THEN '    ' || metric || ': ' || CAST(CAST(value AS DECIMAL(18,1)) AS VARCHAR) || unit
 ELSE '    ' || metric || ': N/A (' || status || ')' END AS line FROM long)
SELECT company, year, chr(10) || '  ' || upper(replace(category, '_', ' ')) || ':' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS text
FROM lines GROUP BY company, year, category""")
def format_metrics(spark, folder):
    # Values are shown with one decimal here so that both engines print the same digits.
    long = ratios.compute_all(financials(spark, folder), KEYS).withColumn("value", F.col("value").cast("decimal(18,1)").cast("double"))
    return peers.format_metrics(long, KEYS).select(*KEYS, "text")


@query("market_comparison", f"""WITH {FIN_SQL}, latest AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY year DESC) AS rn FROM fin)
SELECT company, year, 'price' AS metric, round(nullif(share_price, 0), 4) AS value FROM latest WHERE rn = 1
UNION ALL SELECT company, year, 'market_cap', round(nullif(market_cap, 0), 4) FROM latest WHERE rn = 1
UNION ALL SELECT company, year, 'pe_ratio', {metric_value_sql('pe_ratio')} FROM latest WHERE rn = 1
UNION ALL SELECT company, year, 'price_to_book', {metric_value_sql('price_to_book')} FROM latest WHERE rn = 1
UNION ALL SELECT company, year, 'dividend_yield', nullif({metric_value_sql('dividend_yield')}, 0) FROM latest WHERE rn = 1""")
def market_comparison(spark, folder):
    latest = last_per_key(financials(spark, folder), ["company"], [F.col("year")])
    market = latest.select(
        "company", "year", F.round("share_price", 4).alias("price"), F.round("market_cap", 4).alias("market_cap"),
        *[ratios.metric_col(n)["value"].alias(n) for n in ("pe_ratio", "price_to_book", "dividend_yield")])
    return peers.market_comparison(market, KEYS)


@query("peer_matrix", f"""WITH {FIN_SQL}, {LONG_SQL}, named AS (SELECT DISTINCT company, metric FROM long), compared AS (SELECT DISTINCT year FROM long)
SELECT n.company, n.metric, CAST(c.year AS VARCHAR) AS compared, max(l.value) AS value FROM named n CROSS JOIN compared c
LEFT JOIN long l ON l.company = n.company AND l.metric = n.metric AND l.year = c.year GROUP BY n.company, n.metric, c.year""")
def peer_matrix(spark, folder):
    """The matrix form with fiscal years as the compared columns, for every company; its cells as rows, so that SQL needs no list of years."""
    long = ratios.compute_all(financials(spark, folder), KEYS)
    years = sorted(r["year"] for r in long.select("year").distinct().collect())
    wide = peers.peer_matrix(long, ["company", "metric"], "year", years)
    return wide.unpivot(["company", "metric"], [str(y) for y in years], "compared", "value")
