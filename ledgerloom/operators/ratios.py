"""Financial ratios as one projection over a wide company-year table.

Input columns are those of ``FINANCIAL_COLUMNS``; all are nullable doubles.
Every metric is a struct ``value, unit, formula, status`` (and ``inputs`` when
asked for), so all of them are computed in a single pass inside code generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import numeric as N

FINANCIAL_COLUMNS = (
    "revenue", "cost_of_revenue", "gross_profit", "operating_income", "net_income", "ebitda",
    "interest_expense", "eps", "pretax_income", "tax_provision",
    "total_assets", "total_equity", "total_debt", "total_liabilities", "current_assets",
    "current_liabilities", "cash_and_equivalents", "inventory", "accounts_receivable",
    "accounts_payable",
    "operating_cash_flow", "capital_expenditure",
    "market_cap", "share_price", "shares_outstanding", "enterprise_value", "dividend_per_share",
)

CATEGORIES = ("profitability", "liquidity", "solvency", "cash_flow", "efficiency", "valuation")


CASH_AFTER_CAPEX = "operating_cash_flow - coalesce(abs(capital_expenditure), 0D)"
NET_OF_CASH = "market_cap + coalesce(total_debt, 0D) - coalesce(cash_and_equivalents, 0D)"
EV_OR_SUPPLIED = f"coalesce(enterprise_value, {NET_OF_CASH})"
WORKING_CAPITAL = "current_assets - current_liabilities"
# Known tax share, else what net income leaves of operating income, else a fixed share.
TAX_RATE = """CASE WHEN pretax_income <> 0 AND tax_provision <> 0 THEN tax_provision / pretax_income
 WHEN net_income IS NOT NULL AND operating_income <> 0 THEN greatest(0D, 1 - net_income / operating_income) ELSE 0.25D END"""
AFTER_TAX = f"operating_income * (1 - {TAX_RATE})"
INVESTED = "total_equity + total_debt - coalesce(cash_and_equivalents, 0D)"


@dataclass(frozen=True)
class Metric:
    """A metric as SQL over the wide table: ``num / den``, or the amount ``num`` alone.

    ``den`` None marks an amount.  One parsed expression per metric keeps the plan cheap
    to build; Catalyst shares what the metrics have in common.
    """

    name: str
    category: str
    unit: str
    formula: str
    num: str
    den: str | None = None
    inputs: tuple[tuple[str, str], ...] | None = None

    @property
    def factor(self) -> str:
        return "100D" if self.unit == "%" else "1D"

    def sql(self, with_inputs: bool = False) -> str:
        n, d = f"({self.num})", f"({self.den})"
        if self.den is None:
            value, status = n, f"CASE WHEN {n} IS NULL THEN '{N.MISSING}' ELSE '{N.COMPUTED}' END"
        else:
            value = f"CASE WHEN {d} <> 0 THEN {n} / {d} * {self.factor} END"
            status = (f"CASE WHEN {n} IS NULL OR {d} IS NULL THEN '{N.MISSING}' WHEN {d} = 0 THEN '{N.ZERO_DIVISION}' "
                      f"ELSE '{N.COMPUTED}' END")
        fields = f"'value', round({value}, 4), 'unit', '{self.unit}', 'formula', '{self.formula}', 'status', {status}"
        if with_inputs:
            named = self.inputs or ((self.num, self.num), (self.den, self.den))
            fields += ", 'inputs', map(" + ", ".join(f"'{k}', cast({e} as double)" for k, e in named) + ")"
        return f"named_struct({fields})"

    def column(self, with_inputs: bool = False) -> Column:
        return F.expr(self.sql(with_inputs))


_FCF_INPUT = ("fcf", f"round({CASH_AFTER_CAPEX}, 2)")
METRICS: tuple[Metric, ...] = (
    Metric("gross_margin", "profitability", "%", "Gross Profit / Revenue × 100", "gross_profit", "revenue"),
    Metric("operating_margin", "profitability", "%", "Operating Income / Revenue × 100", "operating_income", "revenue"),
    Metric("net_margin", "profitability", "%", "Net Income / Revenue × 100", "net_income", "revenue"),
    Metric("ebitda_margin", "profitability", "%", "EBITDA / Revenue × 100", "ebitda", "revenue"),
    Metric("roe", "profitability", "%", "Net Income / Total Equity × 100", "net_income", "total_equity"),
    Metric("roa", "profitability", "%", "Net Income / Total Assets × 100", "net_income", "total_assets"),
    Metric("roic", "profitability", "%", "NOPAT / Invested Capital × 100", AFTER_TAX, INVESTED,
           (("nopat", f"round({AFTER_TAX}, 2)"), ("invested_capital", f"round({INVESTED}, 2)"), ("tax_rate", f"round({TAX_RATE}, 4)"))),
    Metric("current_ratio", "liquidity", "x", "Current Assets / Current Liabilities", "current_assets", "current_liabilities"),
    Metric("quick_ratio", "liquidity", "x", "(Current Assets − Inventory) / Current Liabilities",
           "current_assets - coalesce(inventory, 0D)", "current_liabilities",
           (("current_assets", "current_assets"), ("inventory", "coalesce(inventory, 0D)"), ("current_liabilities", "current_liabilities"))),
    Metric("cash_ratio", "liquidity", "x", "Cash & Equivalents / Current Liabilities", "cash_and_equivalents", "current_liabilities"),
    Metric("debt_to_equity", "solvency", "x", "Total Debt / Total Equity", "total_debt", "total_equity"),
    Metric("debt_to_assets", "solvency", "x", "Total Debt / Total Assets", "total_debt", "total_assets"),
    Metric("interest_coverage", "solvency", "x", "Operating Income / Interest Expense", "operating_income", "interest_expense"),
    Metric("equity_multiplier", "solvency", "x", "Total Assets / Total Equity", "total_assets", "total_equity"),
    Metric("free_cash_flow", "cash_flow", "$", "Operating Cash Flow − CapEx", CASH_AFTER_CAPEX, None,
           (("operating_cash_flow", "operating_cash_flow"), ("capital_expenditure", "coalesce(abs(capital_expenditure), 0D)"))),
    Metric("ocf_ratio", "cash_flow", "x", "Operating Cash Flow / Net Income", "operating_cash_flow", "net_income"),
    Metric("capex_to_revenue", "cash_flow", "%", "|CapEx| / Revenue × 100", "abs(capital_expenditure)", "revenue",
           (("capital_expenditure", "abs(capital_expenditure)"), ("revenue", "revenue"))),
    Metric("cash_conversion", "cash_flow", "%", "FCF / Net Income × 100", CASH_AFTER_CAPEX, "net_income",
           (_FCF_INPUT, ("net_income", "net_income"))),
    Metric("fcf_yield", "cash_flow", "%", "FCF / Market Cap × 100", CASH_AFTER_CAPEX, "market_cap",
           (_FCF_INPUT, ("market_cap", "market_cap"))),
    Metric("asset_turnover", "efficiency", "x", "Revenue / Total Assets", "revenue", "total_assets"),
    Metric("inventory_turnover", "efficiency", "x", "Cost of Revenue / Inventory", "cost_of_revenue", "inventory"),
    Metric("receivables_turnover", "efficiency", "x", "Revenue / Accounts Receivable", "revenue", "accounts_receivable"),
    Metric("working_capital_turnover", "efficiency", "x", "Revenue / (Current Assets − Current Liabilities)", "revenue", WORKING_CAPITAL,
           (("revenue", "revenue"), ("working_capital", WORKING_CAPITAL))),
    Metric("payables_turnover", "efficiency", "x", "Cost of Revenue / Accounts Payable", "cost_of_revenue", "accounts_payable"),
    Metric("pe_ratio", "valuation", "x", "Share Price / EPS", "share_price", "eps"),
    Metric("ev_to_ebitda", "valuation", "x", "Enterprise Value / EBITDA", EV_OR_SUPPLIED, "ebitda",
           (("enterprise_value", EV_OR_SUPPLIED), ("ebitda", "ebitda"))),
    Metric("price_to_book", "valuation", "x", "Market Cap / Total Equity", "market_cap", "total_equity"),
    Metric("enterprise_value", "valuation", "$", "Market Cap + Total Debt − Cash", NET_OF_CASH, None,
           (("market_cap", "market_cap"), ("total_debt", "coalesce(total_debt, 0D)"), ("cash_and_equivalents", "coalesce(cash_and_equivalents, 0D)"))),
    Metric("dividend_yield", "valuation", "%", "Dividend Per Share / Share Price × 100", "dividend_per_share", "share_price"),
    Metric("price_to_sales", "valuation", "x", "Market Cap / Revenue", "market_cap", "revenue"),
)

BY_NAME = {m.name: m for m in METRICS}
POSITION = {m.name: i for i, m in enumerate(METRICS)}


def metric_col(name: str, with_inputs: bool = False) -> Column:
    return BY_NAME[name].column(with_inputs)


def single_metric(fin: DataFrame, name: str, keys: list[str], with_inputs: bool = False) -> DataFrame:
    """One metric for every company-year."""
    return fin.select(*keys, metric_col(name, with_inputs).alias("m")).select(*keys, "m.*")


def compute_all(fin: DataFrame, keys: list[str], with_inputs: bool = False) -> DataFrame:
    """Long form: one row per company-year and metric, in catalogue order."""
    rows = F.expr("array(" + ", ".join(
        f"named_struct('category', '{m.category}', 'pos', {i}, 'metric', '{m.name}', 'm', {m.sql(with_inputs)})"
        for i, m in enumerate(METRICS)) + ")")
    return (fin.select(*keys, F.inline(rows))
            .select(*keys, "category", "pos", "metric", "m.*"))


def metric_summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """How many metrics were computed, lacked data or failed."""
    return long.groupBy(*keys).agg(
        F.count_if(F.col("status") == N.COMPUTED).alias("computed"),
        F.count_if(F.col("status") == N.MISSING).alias("missing"),
        F.count_if(~F.col("status").isin(N.COMPUTED, N.MISSING)).alias("errors"),
        F.count(F.lit(1)).alias("total"))


def peg_ratio(price: Column, eps: Column, growth: Column, with_inputs: bool = False) -> Column:
    """P/E over EPS growth in percent; any unusable input is missing data."""
    usable = (price.isNotNull() & eps.isNotNull() & (eps != 0)
              & growth.isNotNull() & (growth != 0))
    value = F.when(usable, price / eps / growth)
    status = F.when(usable, N.COMPUTED).otherwise(N.MISSING)
    inputs = {"pe": F.when(eps != 0, F.round(price / eps, 2)), "eps_growth_pct": growth}
    return N.metric_struct(value, status, "x", "P/E / EPS Growth Rate", inputs if with_inputs else None)


# The audit table of formulas (metric, formula, unit, category).
_EXTRA_FORMULAS = (
    ("revenue_growth", "(Revenue Cur − Revenue Prev) / |Revenue Prev| × 100", "%", "growth"),
    ("net_income_growth", "(NI Cur − NI Prev) / |NI Prev| × 100", "%", "growth"),
    ("eps_growth", "(EPS Cur − EPS Prev) / |EPS Prev| × 100", "%", "growth"),
    ("ebitda_growth", "(EBITDA Cur − EBITDA Prev) / |EBITDA Prev| × 100", "%", "growth"),
    ("cagr", "(End / Start)^(1/Years) − 1", "%", "growth"),
    ("peg_ratio", "P/E / EPS Growth Rate", "x", "valuation"),
)


def formula_registry(spark) -> DataFrame:
    rows = [(m.name, m.formula, m.unit, m.category) for m in METRICS] + list(_EXTRA_FORMULAS)
    return spark.createDataFrame(rows, "metric string, formula string, unit string, category string")
