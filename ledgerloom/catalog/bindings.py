"""How the given tables stand in for company data.

A supplier is a company, a ship year is a fiscal year and the nation is the peer
group.  Line items are summed in whole units (ten-thousandths of revenue, cents of
list price, millionths of tax), so totals do not depend on the order of rows and
are equal in every engine.  Some inputs are left null or zero on purpose so that
every metric status occurs.  ``FIN_SQL`` states the same formulas for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.tables import table


def cents(name: str):
    """A column cut to two decimals by the same arithmetic in both engines; at a tie their
    round() may differ."""
    return F.floor(F.col(name) * 100 + 0.5) / 100


def cents_sql(name: str) -> str:
    return f"floor({name} * 100 + 0.5::DOUBLE) / 100"


def yearly_totals(spark: SparkSession, folder: str) -> DataFrame:
    """One row per supplier and year; partial sums meet in a single shuffle."""
    def whole(c):
        """Nearest whole number; floor stays in primitive arithmetic, round() would not."""
        return F.floor(c + 0.5)

    cents = whole(F.col("l_extendedprice") * 100)
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("company"), F.year("l_shipdate").alias("year"))
        .agg(F.sum(whole(net * 10000)).alias("net_u"),
             F.sum(cents).alias("list_u"),
             F.sum(F.col("l_quantity").cast("long")).alias("qty"),
             F.sum(F.when(F.col("l_returnflag") == "R", cents).otherwise(F.lit(0))).alias("ret_u"),
             F.sum(F.when(F.col("l_linestatus") == "O", cents).otherwise(F.lit(0))).alias("open_u"),
             F.sum(whole(net * F.col("l_tax") * 1000000)).alias("tax_u"),
             F.count(F.lit(1)).alias("n"))
    )


def financials(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    b = (yearly_totals(spark, folder).join(supplier, F.col("company") == F.col("s_suppkey"))
         .select("company", "year", F.col("s_nationkey").alias("peer_group"),
                 F.expr("net_u / 1e4D").alias("revenue"), F.expr("list_u / 1e2D").alias("lst"),
                 F.expr("ret_u / 1e2D").alias("ret"), F.expr("open_u / 1e2D").alias("opn"),
                 F.expr("tax_u / 1e6D").alias("tax"), F.col("qty").cast("double").alias("qty"),
                 F.col("n").cast("double").alias("n"), F.col("s_acctbal").alias("bal"),
                 F.expr("company % 10 = 7").alias("bank")))
    b = b.selectExpr("*", "revenue - lst * 0.55D as gross", "n * 10D as shares")
    b = b.selectExpr("*", "gross - tax - revenue * 0.05D as oi",
                     "if(company % 13 = 0, 0D, ret * 0.02D) as interest", "bal / 10D + 50D as price")
    b = b.selectExpr("*", "oi - interest as pre", "oi - interest - tax * 0.5D as ni",
                     "oi + lst * 0.04D as ebt", "opn * 0.5D + lst * 0.8D as assets",
                     "if(company % 19 = 0, cast(null as double), ret * 0.4D) as debt",
                     "if(company % 23 = 0, cast(null as double), qty * 100D) as cash",
                     "price * shares as mcap")
    b = b.selectExpr("*", "if(company % 17 = 0, 0D, bal * 1000D + assets * 0.3D) as equity",
                     "ni / shares as eps0")
    return b.selectExpr(
        "company", "year", "peer_group", "revenue",
        "if(bank, null, lst * 0.55D) as cost_of_revenue", "if(bank, null, gross) as gross_profit",
        "oi as operating_income", "ni as net_income", "if(bank, null, ebt) as ebitda",
        "interest as interest_expense", "eps0 as eps",
        "if(company % 4 = 1, null, pre) as pretax_income",
        "if(company % 4 = 1, null, tax * 0.5D) as tax_provision",
        "assets as total_assets", "equity as total_equity", "debt as total_debt",
        "assets - equity as total_liabilities", "opn * 0.6D as current_assets",
        "ret * 0.5D as current_liabilities", "cash as cash_and_equivalents",
        "if(bank, null, qty * 50D) as inventory",
        "if(bank, null, opn * 0.1D) as accounts_receivable",
        "if(bank, null, lst * 0.0825D) as accounts_payable",
        "ni + lst * 0.04D as operating_cash_flow",
        "if(company % 6 = 5, null, revenue * -0.1D) as capital_expenditure",
        "mcap as market_cap", "price as share_price", "shares as shares_outstanding",
        "if(company % 3 = 0, mcap + coalesce(debt, 0D) - coalesce(cash, 0D) + 1000D, null) as enterprise_value",
        "if(company % 5 = 2, null, eps0 * 0.2D) as dividend_per_share")


FIN_SQL = """
fin_totals AS (
  SELECT l_suppkey AS company, CAST(year(l_shipdate) AS INTEGER) AS year,
    sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS net_u,
    sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS list_u,
    sum(CAST(l_quantity AS BIGINT)) AS qty,
    sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS ret_u,
    sum(CASE WHEN l_linestatus = 'O' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS open_u,
    sum(CAST(round(l_extendedprice * (1 - l_discount) * l_tax * 1000000) AS BIGINT)) AS tax_u,
    count(*) AS n
  FROM lineitem GROUP BY 1, 2),
fin_a AS (
  SELECT company, year, s_nationkey AS peer_group,
    CAST(net_u AS DOUBLE) / 1e4 AS revenue, CAST(list_u AS DOUBLE) / 1e2 AS lst,
    CAST(ret_u AS DOUBLE) / 1e2 AS ret, CAST(open_u AS DOUBLE) / 1e2 AS opn,
    CAST(tax_u AS DOUBLE) / 1e6 AS tax, CAST(qty AS DOUBLE) AS qty, CAST(n AS DOUBLE) AS n,
    s_acctbal AS bal, company % 10 = 7 AS bank
  FROM fin_totals JOIN supplier ON company = s_suppkey),
fin_b AS (SELECT *, revenue - lst * 0.55::DOUBLE AS gross, n * 10::DOUBLE AS shares FROM fin_a),
fin_c AS (SELECT *, gross - tax - revenue * 0.05::DOUBLE AS oi,
    CASE WHEN company % 13 = 0 THEN 0::DOUBLE ELSE ret * 0.02::DOUBLE END AS interest,
    bal / 10::DOUBLE + 50::DOUBLE AS price FROM fin_b),
fin_d AS (SELECT *, oi - interest AS pre, oi - interest - tax * 0.5::DOUBLE AS ni,
    oi + lst * 0.04::DOUBLE AS ebt, opn * 0.5::DOUBLE + lst * 0.8::DOUBLE AS assets,
    CASE WHEN company % 19 <> 0 THEN ret * 0.4::DOUBLE END AS debt,
    CASE WHEN company % 23 <> 0 THEN qty * 100::DOUBLE END AS cash, price * shares AS mcap FROM fin_c),
fin_e AS (SELECT *, CASE WHEN company % 17 = 0 THEN 0::DOUBLE ELSE bal * 1000::DOUBLE + assets * 0.3::DOUBLE END AS equity,
    ni / shares AS eps0 FROM fin_d),
fin AS (SELECT company, year, peer_group, revenue,
    CASE WHEN NOT bank THEN lst * 0.55::DOUBLE END AS cost_of_revenue, CASE WHEN NOT bank THEN gross END AS gross_profit,
    oi AS operating_income, ni AS net_income, CASE WHEN NOT bank THEN ebt END AS ebitda,
    interest AS interest_expense, eps0 AS eps,
    CASE WHEN company % 4 <> 1 THEN pre END AS pretax_income,
    CASE WHEN company % 4 <> 1 THEN tax * 0.5::DOUBLE END AS tax_provision,
    assets AS total_assets, equity AS total_equity, debt AS total_debt,
    assets - equity AS total_liabilities, opn * 0.6::DOUBLE AS current_assets,
    ret * 0.5::DOUBLE AS current_liabilities, cash AS cash_and_equivalents,
    CASE WHEN NOT bank THEN qty * 50::DOUBLE END AS inventory,
    CASE WHEN NOT bank THEN opn * 0.1::DOUBLE END AS accounts_receivable,
    CASE WHEN NOT bank THEN lst * 0.0825::DOUBLE END AS accounts_payable,
    ni + lst * 0.04::DOUBLE AS operating_cash_flow,
    CASE WHEN company % 6 <> 5 THEN revenue * -0.1::DOUBLE END AS capital_expenditure,
    mcap AS market_cap, price AS share_price, shares AS shares_outstanding,
    CASE WHEN company % 3 = 0 THEN mcap + coalesce(debt, 0) - coalesce(cash, 0) + 1000::DOUBLE END AS enterprise_value,
    CASE WHEN company % 5 <> 2 THEN eps0 * 0.2::DOUBLE END AS dividend_per_share
  FROM fin_e)
"""
