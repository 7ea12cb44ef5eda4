from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import growth, peers, ratios

TCS = dict(
    revenue=100000, cost_of_revenue=60000, gross_profit=40000, operating_income=30000, net_income=25000, ebitda=35000,
    interest_expense=2000, eps=50.0, pretax_income=32000, tax_provision=7000, total_assets=200000, total_equity=80000,
    total_debt=30000, total_liabilities=120000, current_assets=60000, current_liabilities=40000, cash_and_equivalents=25000,
    inventory=5000, accounts_receivable=20000, accounts_payable=12000, operating_cash_flow=32000, capital_expenditure=-8000,
    market_cap=500000, share_price=1000.0, shares_outstanding=500, enterprise_value=505000, dividend_per_share=20.0)
INFY = dict(
    revenue=80000, cost_of_revenue=50000, gross_profit=30000, operating_income=22000, net_income=18000, ebitda=26000,
    interest_expense=1500, eps=45.0, total_assets=150000, total_equity=70000, total_debt=20000, total_liabilities=80000,
    current_assets=50000, current_liabilities=30000, cash_and_equivalents=20000, inventory=3000, accounts_receivable=15000,
    accounts_payable=8000, operating_cash_flow=25000, capital_expenditure=-6000, market_cap=400000, share_price=800.0,
    shares_outstanding=500)
BANK = dict(
    revenue=150000, operating_income=50000, net_income=40000, interest_expense=80000, eps=80.0, total_assets=2000000,
    total_equity=200000, total_debt=1500000, total_liabilities=1800000, current_assets=300000, current_liabilities=200000,
    cash_and_equivalents=100000, operating_cash_flow=60000, capital_expenditure=-5000, market_cap=800000, share_price=1600.0,
    shares_outstanding=500)


def table(spark, rows):
    schema = "company string, year int, peer_group int, pos int, " + ", ".join(f"{c} double" for c in ratios.FINANCIAL_COLUMNS)
    data = [(name, year, 1, i, *[None if d.get(c) is None else float(d[c]) for c in ratios.FINANCIAL_COLUMNS])
            for i, (name, year, d) in enumerate(rows)]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def values(spark):
    rows = ratios.compute_all(table(spark, [("TCS", 2025, TCS), ("BANK", 2025, BANK), ("NONE", 2025, {})]), ["company"], True).collect()
    return {(r.company, r.metric): r for r in rows}


@pytest.mark.parametrize("metric, expected", [
    ("gross_margin", 40), ("operating_margin", 30), ("net_margin", 25), ("ebitda_margin", 35), ("roe", 31.25), ("roa", 12.5),
    ("roic", round(30000 * (1 - 7000 / 32000) / 85000 * 100, 4)), ("current_ratio", 1.5), ("quick_ratio", 1.375), ("cash_ratio", 0.625),
    ("debt_to_equity", 0.375), ("debt_to_assets", 0.15), ("interest_coverage", 15), ("equity_multiplier", 2.5),
    ("free_cash_flow", 24000), ("ocf_ratio", 1.28), ("capex_to_revenue", 8), ("cash_conversion", 96), ("fcf_yield", 4.8),
    ("asset_turnover", 0.5), ("inventory_turnover", 12), ("receivables_turnover", 5), ("working_capital_turnover", 5),
    ("payables_turnover", 5), ("pe_ratio", 20), ("ev_to_ebitda", 14.4286), ("price_to_book", 6.25), ("enterprise_value", 505000),
    ("dividend_yield", 2), ("price_to_sales", 5)])
def test_single_year_values(values, metric, expected):
    assert values["TCS", metric].status == "computed"
    assert values["TCS", metric].value == pytest.approx(expected, abs=1e-4)


def test_missing_inputs(values):
    for metric in ("gross_margin", "ebitda_margin", "inventory_turnover", "receivables_turnover", "payables_turnover", "ev_to_ebitda"):
        assert values["BANK", metric].status == "missing_data"
    assert values["BANK", "quick_ratio"].value == 1.5
    assert {r.status for k, r in values.items() if k[0] == "NONE"} == {"missing_data"}
    assert values["TCS", "gross_margin"].inputs == {"gross_profit": 40000.0, "revenue": 100000.0}


def test_zero_denominator_and_roic_rates(spark):
    zero = {**TCS, "revenue": 0, "total_equity": 0, "current_liabilities": 0}
    no_tax = {**TCS, "pretax_income": 0}
    no_income = {**TCS, "tax_provision": None, "net_income": None}
    rows = ratios.compute_all(table(spark, [("Z", 1, zero), ("N", 1, no_tax), ("F", 1, no_income)]), ["company"]).collect()
    got = {(r.company, r.metric): r for r in rows}
    for metric in ("gross_margin", "roe", "current_ratio", "price_to_book"):
        assert (got["Z", metric].status, got["Z", metric].value) == ("division_by_zero", None)
    assert got["N", "roic"].value == pytest.approx(30000 * (25000 / 30000) / 85000 * 100, abs=1e-4)
    assert got["F", "roic"].value == pytest.approx(30000 * 0.75 / 85000 * 100, abs=1e-4)


def test_summary_counts(spark):
    fin = table(spark, [("TCS", 2025, TCS), ("BANK", 2025, BANK)])
    got = {r.company: r for r in ratios.metric_summary(ratios.compute_all(fin, ["company"]), ["company"]).collect()}
    assert (got["TCS"].computed, got["TCS"].total) == (30, 30)
    assert got["BANK"].missing > 0 and got["BANK"].computed + got["BANK"].missing + got["BANK"].errors == 30


def test_growth(spark):
    prev = dict(revenue=85000, net_income=20000, eps=40.0, ebitda=30000, operating_income=25000)
    fin = table(spark, [("TCS", 2025, TCS), ("TCS", 2023, prev)])
    got = {r.metric: r.value for r in growth.compute_growth(fin, ["company", "year"]).collect()}
    assert got == {"revenue_growth": 17.6471, "net_income_growth": 25.0, "eps_growth": 25.0, "ebitda_growth": 16.6667,
                   "operating_income_growth": 20.0}


def test_cagr_and_peg(spark):
    rows = [(85.0, 100.0, 2, 8.4652), (100.0, 200.0, 5, 14.8698), (100.0, 200.0, 0, None), (0.0, 5.0, 2, None), (10.0, -5.0, 2, None), (10.0, -5.0, 1, -150.0)]
    df = spark.createDataFrame(rows, "s double, e double, n int, x double")
    got = df.select("x", growth.cagr(F.col("s"), F.col("e"), F.col("n")).alias("m")).collect()
    assert [r.m.value for r in got] == [r.x for r in got]
    assert [r.m.status for r in got] == ["computed", "computed", "missing_data", "division_by_zero", "anomaly", "computed"]
    peg = df.select(ratios.peg_ratio(F.lit(1000.0), F.lit(50.0), F.lit(25.0)).alias("m")).first().m
    assert (peg.value, peg.status) == (0.8, "computed")


def test_trends(spark):
    years = [(2023, 80000, 18000, 36), (2024, 90000, 22000, 44), (2025, 100000, 25000, 50)]
    fin = table(spark, [("A", y, dict(revenue=r, net_income=n, eps=e)) for y, r, n, e in reversed(years)] + [("B", 2025, TCS)])
    got = {r.company: r for r in growth.compute_trends(fin).collect()}
    assert [p.revenue for p in got["A"].series] == [80000, 90000, 100000]
    assert got["A"].revenue_cagr.value == pytest.approx(11.8034, abs=1e-4)
    assert [x.revenue_growth for x in got["A"].yoy_growth] == [12.5, 11.1111]
    assert got["B"].error and got["B"].series is None


def test_peers(spark):
    fin = table(spark, [("TCS", 2025, TCS), ("INFY", 2025, INFY), ("BANK", 2025, BANK)])
    long = ratios.compute_all(fin.withColumnRenamed("pos", "seat"), ["company", "peer_group", "seat"])
    rows = peers.compare_peers(long, ["peer_group"], "seat").collect()
    order = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        order.setdefault(r.metric, []).append(r.company)
    assert order["roe"] == ["TCS", "INFY", "BANK"]
    assert order["debt_to_equity"] == ["INFY", "TCS", "BANK"]
    assert order["gross_margin"] == ["TCS", "INFY"]


def test_health(spark):
    fin = table(spark, [("TCS", 2025, TCS), ("NONE", 2025, {})])
    got = {r.company: r for r in peers.health_score(fin, ["company"]).collect()}
    assert (got["TCS"].overall, got["TCS"].profitability_score) == (87.8, 91.7)
    assert got["NONE"].overall == 0


def test_format_metrics(spark):
    long = ratios.compute_all(table(spark, [("BANK", 2025, BANK)]), ["company"])
    text = peers.format_metrics_text(long, ["company"], "liquidity").first().text
    assert text == "\n  LIQUIDITY:\n    current_ratio: 1.5x\n    quick_ratio: 1.5x\n    cash_ratio: 0.5x"
    assert "    gross_margin: N/A (missing_data)" in peers.format_metrics_text(long, ["company"]).first().text
