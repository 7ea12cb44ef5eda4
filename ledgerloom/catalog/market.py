"""Queries over market data.

A part is a listing: its info document is JSON that Spark writes from the part row, with
keys left out or zero by rule.  Events are price ticks of a user, who is a ticker.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.catalog.bindings import FIN_SQL, cents, cents_sql, financials
from ledgerloom.catalog.registry import query
from ledgerloom.operators import peers, ratios
from ledgerloom.sources import market as M
from ledgerloom.sources import universe as U
from ledgerloom.tables import table

# Key of an info document, Spark and DuckDB expression alike over the part row.
INFO_FIELDS = {
    "longName": "CASE WHEN p_partkey % 5 <> 0 THEN p_name END", "shortName": "CASE WHEN p_partkey % 10 <> 0 THEN p_brand END",
    "sector": "CASE WHEN p_partkey % 7 <> 0 THEN p_type END", "currency": "CASE WHEN p_partkey % 2 = 0 THEN 'USD' END",
    "exchange": "CASE p_partkey % 3 WHEN 0 THEN 'NSE' WHEN 1 THEN 'NMS' ELSE 'LSE' END",
    "currentPrice": "CASE p_partkey % 4 WHEN 0 THEN p_retailprice * 0 WHEN 1 THEN NULL ELSE p_retailprice END",
    "regularMarketPrice": "p_retailprice + 1", "previousClose": "CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END",
    "regularMarketPreviousClose": "CASE WHEN p_partkey % 6 <> 1 THEN p_retailprice + 2 END",
    "open": "CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END", "regularMarketOpen": "p_retailprice + 3",
    "dayHigh": "p_retailprice + 4", "dayLow": "p_retailprice - 4",
    "marketCap": "CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice * 1000 END",
    "enterpriseValue": "CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice * 1100 END", "sharesOutstanding": "p_size * 10.0",
    "trailingPE": "CASE WHEN p_partkey % 6 <> 0 THEN p_size / 2.0 END", "forwardPE": "p_size / 4.0", "pegRatio": "p_size / 8.0",
    "priceToBook": "CASE WHEN p_partkey % 8 <> 0 THEN p_size / 16.0 END", "trailingEps": "p_size * 0.5", "beta": "p_size / 32.0",
    "dividendYield": "CASE WHEN p_partkey % 5 <> 3 THEN p_size / 64.0 END", "dividendRate": "p_size / 128.0",
    "fiftyTwoWeekHigh": "p_retailprice + 10", "fiftyTwoWeekLow": "p_retailprice - 10", "totalRevenue": "p_retailprice * 500",
    "grossProfits": "p_retailprice * 200", "operatingIncome": "CASE WHEN p_partkey % 3 = 1 THEN p_retailprice * 100 END",
    "ebitda": "p_retailprice * 125", "netIncomeToCommon": "p_retailprice * 80", "totalAssets": "p_retailprice * 900",
    "bookValue": "CASE p_partkey % 5 WHEN 0 THEN p_retailprice * 0 WHEN 1 THEN NULL ELSE p_size * 0.25 END",
    "totalDebt": "p_retailprice * 50", "totalCurrentAssets": "p_retailprice * 300", "totalCurrentLiabilities": "p_retailprice * 250",
    "totalCash": "p_retailprice * 20", "operatingCashflow": "p_retailprice * 90",
    "volume": "CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 3 END", "regularMarketVolume": "p_partkey + 5", "averageVolume": "p_partkey + 7",
    "fullTimeEmployees": "p_size * 100",
}
_INT = {"volume", "regularMarketVolume", "averageVolume", "fullTimeEmployees"}
_TEXT = {"longName", "shortName", "sector", "currency", "exchange"}


def _typed(name, e, double="double"):
    if name in _TEXT:
        return e
    return f"CAST({e} AS {'bigint' if name in _INT else double})"


INFO_SQL = "info AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS ticker, " + ", ".join(
    f'{_typed(n, e)} AS "{n}"' for n, e in INFO_FIELDS.items()) + " FROM part)"


def info(spark, folder):
    fields = ", ".join(f"{_typed(n, e)} AS {n}" for n, e in INFO_FIELDS.items())
    raw = table(spark, folder, "part").selectExpr("concat(' p', p_partkey) AS ticker", f"to_json(struct({fields})) AS info")
    return M.parse_info(raw)


def _or(a, b):
    return f'coalesce(nullif("{a}", 0), "{b}")'


PRICE_SQL = {"current": _or("currentPrice", "regularMarketPrice"), "open": _or("open", "regularMarketOpen"),
             "high": '"dayHigh"', "low": '"dayLow"', "previous_close": _or("previousClose", "regularMarketPreviousClose")}


@query("company_profile", f"""WITH {INFO_SQL} SELECT ticker, coalesce("longName", "shortName", 'Unknown') AS company_name, coalesce(sector, 'N/A') AS sector,
 'N/A' AS industry, 'N/A' AS country, coalesce(currency, 'N/A') AS currency, "marketCap" AS market_cap, "fullTimeEmployees" AS employees,
 'N/A' AS website, 'N/A' AS description, exchange FROM info""")
def company_profile(spark, folder):
    return M.company_profile(info(spark, folder))


FLAT_SQL = f"""{PRICE_SQL['current']} AS current_price, {PRICE_SQL['previous_close']} AS previous_close, {PRICE_SQL['open']} AS open, "dayHigh" AS day_high, "dayLow" AS day_low,
 {_or('volume', 'regularMarketVolume')} AS volume, "averageVolume" AS average_volume, "fiftyTwoWeekHigh" AS fifty_two_week_high,
 "fiftyTwoWeekLow" AS fifty_two_week_low, "trailingPE" AS pe_ratio, "forwardPE" AS forward_pe, "dividendYield" AS dividend_yield, beta"""


@query("market_data_flat", f"WITH {INFO_SQL} SELECT ticker, {FLAT_SQL} FROM info")
def market_data_flat(spark, folder):
    return M.market_data_flat(info(spark, folder))


@query("market_snapshot", f"""WITH {INFO_SQL} SELECT ticker, currency, {PRICE_SQL['current']} AS current, {PRICE_SQL['open']} AS open, "dayHigh" AS high, "dayLow" AS low,
 {PRICE_SQL['previous_close']} AS previous_close, "marketCap" AS market_cap, "enterpriseValue" AS enterprise_value, "sharesOutstanding" AS shares_outstanding,
 "trailingPE" AS pe_ratio, "forwardPE" AS forward_pe, "pegRatio" AS peg_ratio, "priceToBook" AS price_to_book, "trailingEps" AS eps,
 {_or('volume', 'regularMarketVolume')} AS volume, "averageVolume" AS average_volume, beta, "dividendYield" AS dividend_yield,
 "fiftyTwoWeekHigh" AS fifty_two_week_high, "fiftyTwoWeekLow" AS fifty_two_week_low FROM info""")
def market_snapshot(spark, folder):
    return M.market_snapshot(info(spark, folder)).select("ticker", "currency", "price.*", "valuation.*", "multiples.*", "trading.*")


@query("listing_comparison", f"""WITH {INFO_SQL}, m AS (SELECT ticker, {PRICE_SQL['current']} AS price, "marketCap" AS market_cap, "trailingPE" AS pe_ratio, "forwardPE" AS forward_pe,
 "priceToBook" AS price_to_book, "dividendYield" AS dividend_yield FROM info)
SELECT ticker, 'price' AS metric, CAST(nullif(price, 0) AS DOUBLE) AS value FROM m UNION ALL SELECT ticker, 'market_cap', CAST(nullif(market_cap, 0) AS DOUBLE) FROM m
UNION ALL SELECT ticker, 'pe_ratio', CAST(pe_ratio AS DOUBLE) FROM m UNION ALL SELECT ticker, 'forward_pe', CAST(forward_pe AS DOUBLE) FROM m
UNION ALL SELECT ticker, 'price_to_book', CAST(price_to_book AS DOUBLE) FROM m UNION ALL SELECT ticker, 'dividend_yield', CAST(nullif(dividend_yield, 0) AS DOUBLE) FROM m""")
def listing_comparison(spark, folder):
    """The market comparison of all listings, forward P/E included."""
    snap = M.market_snapshot(info(spark, folder)).select("ticker", F.col("price.current").alias("price"), "valuation.market_cap", "multiples.pe_ratio",
                                                         "multiples.forward_pe", "multiples.price_to_book", "trading.dividend_yield")
    return peers.market_comparison(snap, ["ticker"])


@query("company_overview", f"""WITH {INFO_SQL} SELECT ticker, coalesce("longName", "shortName", 'Unknown') AS company_name, {PRICE_SQL['current']} AS current_price, "trailingPE" AS pe_ratio FROM info""")
def company_overview(spark, folder):
    i = info(spark, folder)
    return M.company_overview(M.company_profile(i), M.market_data_flat(i)).select(
        "ticker", "company_name", "market_data.current_price", "market_data.pe_ratio")


@query("financials_wide", f"""WITH {INFO_SQL} SELECT ticker AS company, "totalRevenue" AS revenue, {_or('operatingIncome', 'ebitda')} AS operating_income,
 CASE WHEN coalesce("bookValue", 0) = 0 THEN "bookValue" ELSE "bookValue" * "sharesOutstanding" END AS total_equity, {PRICE_SQL['current']} AS share_price,
 CASE WHEN "bookValue" <> 0 THEN round("netIncomeToCommon" / ("bookValue" * "sharesOutstanding") * 100::DOUBLE, 4) END AS roe FROM info""")
def financials_wide(spark, folder):
    f = M.financials_wide(info(spark, folder))
    return f.select("company", "revenue", "operating_income", "total_equity", "share_price", ratios.metric_col("roe")["value"].alias("roe"))


def ticks(spark, folder):
    return table(spark, folder, "events").select(
        F.concat(F.lit("U"), "user_id").alias("ticker"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"))


BAR_SQL = """bars AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
 min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL)"""


@query("price_history", f"""WITH {BAR_SQL}, w AS (SELECT * FROM bars WHERE date >= (SELECT max(date) FROM bars) - INTERVAL 1 MONTH)
SELECT ticker, date, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close, round(close, 2) AS adjusted_close,
 volume, count(*) OVER (PARTITION BY ticker) AS count, '1mo' AS period FROM w""")
def price_history(spark, folder):
    return M.price_history(M.day_bars(ticks(spark, folder)), "1mo")


@query("price_windows", f"""WITH {BAR_SQL}, p(period, months) AS (VALUES ('1mo', 1), ('3mo', 3), ('6mo', 6), ('1y', 12), ('5y', 60), ('max', 12000)),
w AS (SELECT bars.*, period FROM bars JOIN p ON date >= (SELECT max(date) FROM bars) - to_months(months))
SELECT ticker, period, count(*) AS count, min(date) AS first_date, round(min(low), 2) AS low, round(max(high), 2) AS high,
 round(arg_min(open, date), 2) AS first_open, round(arg_max(close, date), 2) AS last_close FROM w GROUP BY ticker, period""")
def price_windows(spark, folder):
    """All look-backs of all tickers."""
    return M.price_windows(M.day_bars(ticks(spark, folder)))


# Line item of the statement and the column it comes from.
ITEMS = {"Total Revenue ": "revenue", " Net Income": "net_income", "EBITDA": "ebitda", "Operating Cash Flow": "operating_cash_flow"}


@query("statement_records", f"WITH {FIN_SQL} SELECT 'T' || company AS ticker, CAST(year AS VARCHAR) AS period, {cents_sql('revenue')} AS total_revenue, {cents_sql('net_income')} AS net_income, {cents_sql('ebitda')} AS ebitda, {cents_sql('operating_cash_flow')} AS operating_cash_flow FROM fin")
def statement_records(spark, folder):
    fin = financials(spark, folder)
    rows = fin.select(F.concat(F.lit("T"), "company").alias("ticker"), F.col("year").cast("string").alias("year"), F.inline(F.array(*[
        F.struct(F.lit(item).alias("line_item"), F.coalesce(cents(c), F.lit(float("nan"))).alias("value")) for item, c in ITEMS.items()])))
    # The fiscal years there are: a handful, whatever the number of rows.
    periods = sorted(r["year"] for r in fin.select(F.col("year").cast("string").alias("year")).distinct().collect())
    wide = rows.groupBy("ticker", "line_item").pivot("year", periods).agg(F.first("value"))
    return M.statement_records(wide, periods, ["total_revenue", "net_income", "ebitda", "operating_cash_flow"])


# --- quotes ----------------------------------------------------------------------

_UNI_SQL = "[" + ", ".join(f"'{r[1]}'" for r in U.ROWS) + "]"
_UNI_VALUES = "uni(pos, ticker, display, name, market, exchange, sector) AS (VALUES " + ", ".join(
    "(" + ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in U.ROWS) + ")"
SYMBOL = f"CASE WHEN user_id % 3 = 0 THEN {{u}}[user_id % 54 + {{base}}] ELSE 'U' || CAST(user_id AS {{s}}) END"


def charts(spark, folder):
    """One chart document per user: hourly closes, so its size is bounded by the time covered."""
    array = "array(" + ", ".join(f"'{r[1]}'" for r in U.ROWS) + ")"
    hours = table(spark, folder, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("close"))
    g = hours.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("h", "close"))).alias("c"), F.max("h").alias("last"))
    return g.selectExpr(
        "user_id", f"CASE WHEN user_id % 3 = 0 THEN element_at({array}, cast(user_id % 54 + 1 as int)) ELSE concat('U', user_id) END AS symbol",
        "c", "last").selectExpr("user_id", """to_json(named_struct('chart', named_struct('result', array(named_struct(
          'meta', named_struct('symbol', symbol, 'shortName', if(user_id % 2 = 0, concat('Short ', user_id), null), 'currency', if(user_id % 4 = 0, 'INR', null),
            'exchangeName', case user_id % 5 when 0 then 'NSI' when 1 then 'NMS' else 'LSE' end,
            'regularMarketPrice', if(user_id % 17 = 5, null, element_at(c.close, -1)), 'chartPreviousClose', if(user_id % 7 = 1, c.close[0], if(user_id % 7 = 2, 0D, null)),
            'regularMarketChangePercent', if(user_id % 11 = 3, 1.5D, null), 'regularMarketTime', unix_timestamp(last)),
          'indicators', named_struct('quote', array(named_struct('close', concat(array(cast(null as double)), c.close)))))))),
          map('ignoreNullFields', 'false')) AS chart_json""")


CHART_SQL = f"""{_UNI_VALUES}, hr AS (SELECT user_id, date_trunc('hour', ts) AS h, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL),
ch AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN {_UNI_SQL}[user_id % 54 + 1] ELSE 'U' || CAST(user_id AS VARCHAR) END AS symbol,
 list(close ORDER BY h) AS c, max(h) AS last FROM hr GROUP BY user_id),
qt0 AS (SELECT *, c[-1] AS price, coalesce(CASE WHEN user_id % 7 = 1 THEN nullif(c[1], 0) END, CASE WHEN len(c) >= 2 THEN c[-2] ELSE c[-1] END) AS previous,
 CASE user_id % 5 WHEN 0 THEN 'NSI' WHEN 1 THEN 'NMS' ELSE 'LSE' END AS ex FROM ch WHERE user_id % 17 <> 5),
qt AS (SELECT symbol AS ticker, coalesce(uni.name, CASE WHEN user_id % 2 = 0 THEN 'Short ' || user_id END, symbol) AS name, coalesce(uni.exchange, ex) AS exchange,
 CASE WHEN user_id % 4 = 0 THEN 'INR' ELSE 'USD' END AS currency, price, round(price - previous, 6) AS change,
 round(CASE WHEN user_id % 11 = 3 THEN 1.5::DOUBLE WHEN previous <> 0 THEN (price - previous) / previous * 100 ELSE 0 END, 6) AS "changePercent", previous AS "previousClose",
 array_to_string(list_transform(c[-60:], lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',') AS spark,
 coalesce(uni.market, CASE WHEN ex = 'NSI' THEN 'IN' WHEN ex = 'NMS' THEN 'US' WHEN regexp_matches(symbol, '^[A-Z]{{1,6}}$') THEN 'US' ELSE 'OTHER' END) AS market,
 strftime(last, '%Y-%m-%dT%H:%M:%SZ') AS "asOf" FROM qt0 LEFT JOIN uni ON upper(symbol) = uni.ticker)"""


def quotes(spark, folder):
    q = M.chart_quote(charts(spark, folder))
    return q.select("ticker", "name", "exchange", "currency", "price", F.round("change", 6).alias("change"), F.round("changePercent", 6).alias("changePercent"),
                    "previousClose", F.array_join(F.transform("spark", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("spark"), "market", "asOf")


@query("chart_quote", f"WITH {CHART_SQL} SELECT * FROM qt")
def chart_quote(spark, folder):
    return quotes(spark, folder)


@query("quotes_batch", f"WITH {CHART_SQL} SELECT ticker, name, price FROM qt WHERE ticker IN (SELECT 'U' || CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P')")
def quotes_batch(spark, folder):
    asked = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("U"), "o_custkey").alias("ticker"))
    return M.quotes_batch(quotes(spark, folder), asked).select("ticker", "name", "price")


@query("find_company", f"""WITH {_UNI_VALUES}, t AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN ' ' || lower({_UNI_SQL}[p_partkey % 54 + 1]) || ' ' ELSE split_part({_UNI_SQL}[p_partkey % 54 + 1], '.', 1) || CASE WHEN p_partkey % 9 = 0 THEN 'X' ELSE '' END END AS ticker FROM part)
SELECT p_partkey, u.ticker AS found, u.sector FROM t LEFT JOIN uni u ON upper(trim(t.ticker)) = u.ticker OR upper(trim(t.ticker)) = u.display""")
def find_company(spark, folder):
    array = "array(" + ", ".join(f"'{r[1]}'" for r in U.ROWS) + ")"
    symbol = f"element_at({array}, cast(p_partkey % 54 + 1 as int))"
    rows = table(spark, folder, "part").selectExpr("p_partkey", f"""CASE WHEN p_partkey % 4 = 0 THEN concat(' ', lower({symbol}), ' ')
      ELSE concat(split_part({symbol}, '.', 1), if(p_partkey % 9 = 0, 'X', '')) END AS ticker""")
    return U.find_company(rows).select("p_partkey", F.col("known.ticker").alias("found"), F.col("known.sector").alias("sector"))


RAW_TICKER = "CASE p_partkey % 8 WHEN 0 THEN 'ab' || p_partkey WHEN 1 THEN 'AB.NS' WHEN 2 THEN p_name WHEN 3 THEN '' WHEN 4 THEN 'A&B-C=' || p_size WHEN 5 THEN 'msft' WHEN 6 THEN '^GSPC' ELSE 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || p_size END"
RAW_EXCHANGE = "CASE p_partkey % 5 WHEN 0 THEN 'nse' WHEN 1 THEN 'NasdaqGS' WHEN 2 THEN NULL WHEN 3 THEN 'NYQ' ELSE 'LSE' END"


def listings(spark, folder):
    return table(spark, folder, "part").selectExpr("p_partkey", f"{RAW_TICKER} AS ticker", f"{RAW_EXCHANGE} AS exchange")


@query("validate_ticker", f"SELECT p_partkey, CASE WHEN regexp_matches({RAW_TICKER}, '^[A-Za-z0-9^.&=-]{{1,24}}$') THEN upper({RAW_TICKER}) END AS valid FROM part")
def validate_ticker(spark, folder):
    return listings(spark, folder).select("p_partkey", U.validate_ticker("ticker").alias("valid"))


MARKET_SQL = """CASE WHEN regexp_matches(upper(t), '\\.(NS|BO)$') OR regexp_matches(upper(coalesce(e, '')), 'NSE|NSI|BSE') THEN 'IN'
 WHEN regexp_matches(upper(coalesce(e, '')), 'NASDAQ|NYSE|NMS|NYQ|PCX') THEN 'US' WHEN regexp_matches(upper(t), '^[A-Z]{1,6}$') THEN 'US' ELSE 'OTHER' END"""


@query("infer_market", f"SELECT p_partkey, {MARKET_SQL} AS market FROM (SELECT p_partkey, {RAW_TICKER} AS t, {RAW_EXCHANGE} AS e FROM part)")
def infer_market(spark, folder):
    return listings(spark, folder).select("p_partkey", U.infer_market("ticker", "exchange").alias("market"))


@query("resolve_ticker", """WITH known AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'S' || s_suppkey || '.NS' ELSE 'S' || s_suppkey END AS symbol FROM supplier),
t AS (SELECT c_custkey, upper(CASE WHEN c_custkey % 7 = 0 THEN 'S' || c_custkey || '.BO' ELSE 'S' || (c_custkey % 500) END) AS x FROM customer)
SELECT c_custkey, CASE WHEN contains(x, '.') OR x IN (SELECT symbol FROM known) THEN x WHEN x || '.NS' IN (SELECT symbol FROM known) THEN x || '.NS' ELSE x END AS resolved FROM t""")
def resolve_ticker(spark, folder):
    known = table(spark, folder, "supplier").selectExpr("if(s_suppkey % 3 = 0, concat('s', s_suppkey, '.ns'), concat('S', s_suppkey)) AS symbol")
    rows = table(spark, folder, "customer").selectExpr("c_custkey", "if(c_custkey % 7 = 0, concat(' s', c_custkey, '.bo'), concat('s', c_custkey % 500, ' ')) AS ticker")
    return U.resolve_ticker(rows, known).select("c_custkey", "resolved")


@query("search_tickers", f"""WITH s AS (SELECT p_partkey, {RAW_TICKER} AS t, {RAW_EXCHANGE} AS e, p_name, p_brand FROM part WHERE p_partkey % 3 <> 2)
SELECT p_partkey // 10 AS search_id, t AS ticker, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS name, coalesce(e, '') AS exchange, {MARKET_SQL} AS market, 'Equity' AS type FROM s WHERE t <> ''""")
def search_tickers(spark, folder):
    """Search answers of ten listings each, written as JSON by Spark."""
    raw = table(spark, folder, "part").selectExpr(
        "p_partkey div 10 AS search_id",
        f"""named_struct('symbol', {RAW_TICKER}, 'quoteType', if(p_partkey % 3 = 0, 'EQUITY', 'ETF'), 'typeDisp', if(p_partkey % 3 = 1, 'Equity', null),
          'shortname', if(p_partkey % 2 = 0, p_name, ''), 'longname', p_brand, 'exchDisp', {RAW_EXCHANGE}) AS q""")
    docs = raw.groupBy("search_id").agg(F.to_json(F.struct(F.collect_list("q").alias("quotes"))).alias("search_json"))
    return M.search_tickers(docs, ["search_id"]).drop("pos")
