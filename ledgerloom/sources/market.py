"""Market data from landed JSON: profiles, snapshots, statements, prices, quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.numeric import not_nan, safe_or
from ledgerloom.sources.universe import find_company, infer_market

# Fields of an info document.
_TEXT = ("symbol", "longName", "shortName", "sector", "industry", "country", "currency", "website",
         "longBusinessSummary", "exchange")
_DOUBLE = ("currentPrice", "regularMarketPrice", "previousClose", "regularMarketPreviousClose", "open",
           "regularMarketOpen", "dayHigh", "regularMarketDayHigh", "dayLow", "regularMarketDayLow", "marketCap",
           "enterpriseValue", "sharesOutstanding", "trailingPE", "forwardPE", "pegRatio", "priceToBook", "trailingEps",
           "beta", "dividendYield", "dividendRate", "fiftyTwoWeekHigh", "fiftyTwoWeekLow", "totalRevenue", "grossProfits",
           "operatingIncome", "ebitda", "netIncomeToCommon", "totalAssets", "bookValue", "totalDebt", "totalCurrentAssets",
           "totalCurrentLiabilities", "totalCash", "operatingCashflow", "freeCashflow")
_LONG = ("volume", "regularMarketVolume", "averageVolume", "fullTimeEmployees")
INFO_SCHEMA = ", ".join([f"{n} string" for n in _TEXT] + [f"{n} double" for n in _DOUBLE] + [f"{n} bigint" for n in _LONG])
PERIOD_MONTHS = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "5y": 60}


def parse_info(raw: DataFrame, c: str = "info") -> DataFrame:
    """Info documents as columns; a key a document lacks is null."""
    return raw.select("ticker", F.from_json(c, INFO_SCHEMA, {"allowNonNumericNumbers": "true"}).alias("i")).select("ticker", "i.*")


def _ticker() -> Column:
    return F.upper(T.strip("ticker"))


def company_profile(info: DataFrame) -> DataFrame:
    def text(name):
        return F.coalesce(name, F.lit("N/A"))

    return info.select(
        _ticker().alias("ticker"),
        F.coalesce(T.truthy("longName"), "shortName", F.lit("Unknown")).alias("company_name"),
        text("sector").alias("sector"), text("industry").alias("industry"), text("country").alias("country"),
        text("currency").alias("currency"), not_nan("marketCap").alias("market_cap"), F.col("fullTimeEmployees").alias("employees"),
        text("website").alias("website"), text("longBusinessSummary").alias("description"), text("exchange").alias("exchange"))


def price_fields() -> dict[str, Column]:
    return {"current": safe_or("currentPrice", "regularMarketPrice"), "open": safe_or("open", "regularMarketOpen"),
            "high": safe_or("dayHigh", "regularMarketDayHigh"), "low": safe_or("dayLow", "regularMarketDayLow"),
            "previous_close": safe_or("previousClose", "regularMarketPreviousClose")}


def valuation_fields() -> dict[str, Column]:
    return {"market_cap": not_nan("marketCap"), "enterprise_value": not_nan("enterpriseValue"),
            "shares_outstanding": not_nan("sharesOutstanding")}


def multiple_fields() -> dict[str, Column]:
    return {"pe_ratio": not_nan("trailingPE"), "forward_pe": not_nan("forwardPE"), "peg_ratio": not_nan("pegRatio"),
            "price_to_book": not_nan("priceToBook"), "eps": not_nan("trailingEps")}


def trading_fields() -> dict[str, Column]:
    return {"volume": safe_or("volume", "regularMarketVolume"), "average_volume": F.col("averageVolume"),
            "beta": not_nan("beta"), "dividend_yield": not_nan("dividendYield"),
            "fifty_two_week_high": not_nan("fiftyTwoWeekHigh"), "fifty_two_week_low": not_nan("fiftyTwoWeekLow")}


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def market_snapshot(info: DataFrame) -> DataFrame:
    return info.select(
        _ticker().alias("ticker"), "currency", _struct(price_fields()).alias("price"),
        _struct(valuation_fields()).alias("valuation"), _struct(multiple_fields()).alias("multiples"),
        _struct(trading_fields()).alias("trading"))


def market_data_flat(info: DataFrame) -> DataFrame:
    p, m, t = price_fields(), multiple_fields(), trading_fields()
    fields = {"current_price": p["current"], "previous_close": p["previous_close"], "open": p["open"], "day_high": p["high"],
              "day_low": p["low"], "volume": t["volume"], "average_volume": t["average_volume"],
              "fifty_two_week_high": t["fifty_two_week_high"], "fifty_two_week_low": t["fifty_two_week_low"],
              "pe_ratio": m["pe_ratio"], "forward_pe": m["forward_pe"], "dividend_yield": t["dividend_yield"], "beta": t["beta"]}
    return info.select(_ticker().alias("ticker"), *[c.alias(n) for n, c in fields.items()])


def company_overview(profiles: DataFrame, market: DataFrame) -> DataFrame:
    """Profile with the market row of the same ticker under ``market_data``."""
    fields = [c for c in market.columns if c != "ticker"]
    return profiles.join(market.select("ticker", F.struct(*fields).alias("market_data")), "ticker")


def financials_wide(info: DataFrame) -> DataFrame:
    """Ratio-engine input from an info document."""
    book, shares = F.col("bookValue"), F.col("sharesOutstanding")
    equity = F.when(book.isNull() | (book == 0), book).when(shares.isNull() | (shares == 0), shares).otherwise(book * shares)
    none = F.lit(None).cast("double")
    fields = {
        "revenue": "totalRevenue", "cost_of_revenue": none, "gross_profit": "grossProfits",
        "operating_income": safe_or("operatingIncome", "ebitda"), "net_income": "netIncomeToCommon", "ebitda": "ebitda",
        "interest_expense": none, "eps": "trailingEps", "pretax_income": none, "tax_provision": none,
        "total_assets": "totalAssets", "total_equity": equity, "total_debt": "totalDebt", "total_liabilities": none,
        "current_assets": "totalCurrentAssets", "current_liabilities": "totalCurrentLiabilities",
        "cash_and_equivalents": "totalCash", "inventory": none, "accounts_receivable": none, "accounts_payable": none,
        "operating_cash_flow": "operatingCashflow", "capital_expenditure": none, "market_cap": "marketCap",
        "share_price": safe_or("currentPrice", "regularMarketPrice"), "shares_outstanding": "sharesOutstanding",
        "enterprise_value": "enterpriseValue", "dividend_per_share": "dividendRate",
    }
    return info.select(_ticker().alias("company"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()])


def line_item_key(c) -> Column:
    return F.lower(F.replace(T.strip(c), F.lit(" "), F.lit("_")))


def statement_items(wide: DataFrame, periods: list[str]) -> DataFrame:
    """Long form of a statement whose columns are periods: ``ticker, period, item, value``."""
    long = wide.unpivot(["ticker", "line_item"], periods, "period", "value")
    return long.select("ticker", "period", line_item_key("line_item").alias("item"), F.round(not_nan("value"), 2).alias("value"))


def statement_records(wide: DataFrame, periods: list[str], items: list[str]) -> DataFrame:
    """One row per ticker and period with the named items as columns."""
    return (statement_items(wide, periods).groupBy("ticker", "period")
            .pivot("item", items).agg(F.first("value", ignorenulls=True)))


def day_bars(ticks: DataFrame) -> DataFrame:
    """Daily bars from ticks (``ticker, ts, seq, price``); partial bars meet in the shuffle."""
    at = F.struct("ts", "seq")
    return ticks.groupBy("ticker", F.to_date("ts").alias("date")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("volume"))


def _rounded(bars: DataFrame, *more: str) -> DataFrame:
    rounded = [F.round(c, 2).alias(c) for c in ("open", "high", "low", "close")]
    return bars.select("ticker", "date", *more, *rounded, F.round("close", 2).alias("adjusted_close"), F.col("volume").cast("long").alias("volume"))


def _last_day(bars: DataFrame, as_of) -> Column:
    """The day that look-backs count from: as given, else the last one of all bars, found when the query runs."""
    return F.lit(as_of) if as_of is not None else bars.agg(F.max("date")).scalar()


def price_history(bars: DataFrame, period: str = "1y", as_of=None) -> DataFrame:
    """Bars inside the look-back, rounded, with the number of bars per ticker."""
    if period != "max":
        bars = bars.where(F.col("date") >= F.add_months(_last_day(bars, as_of), -PERIOD_MONTHS[period]))
    out = _rounded(bars)
    counts = out.groupBy("ticker").agg(F.count(F.lit(1)).alias("count"))
    return out.join(counts, "ticker").withColumn("period", F.lit(period))


def price_windows(bars: DataFrame, as_of=None) -> DataFrame:
    """Every look-back at once: ``ticker, period, count, first_date, low, high, first_open, last_close`` from one pass over the bars.

    A bar goes to the look-backs that hold its day, at most one row for each of them; they meet in
    partial aggregates, so what is shuffled is one row per ticker and look-back from every task.
    """
    months = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(m).alias("months")) for p, m in PERIOD_MONTHS.items()])
    dated = bars.withColumn("_last", _last_day(bars, as_of))
    held = F.filter(months, lambda w: F.col("date") >= F.add_months("_last", -w["months"]))
    periods = F.concat(F.transform(held, lambda w: w["period"]), F.array(F.lit("max")))
    rows = _rounded(dated.withColumn("period", F.explode(periods)), "period")
    return rows.groupBy("ticker", "period").agg(
        F.count(F.lit(1)).alias("count"), F.min("date").alias("first_date"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min_by("open", "date").alias("first_open"), F.max_by("close", "date").alias("last_close"))


CHART_SCHEMA = """chart struct<result:array<struct<
  meta:struct<symbol:string,shortName:string,longName:string,currency:string,exchangeName:string,fullExchangeName:string,
    regularMarketPrice:double,chartPreviousClose:double,regularMarketChangePercent:double,regularMarketDayHigh:double,
    regularMarketDayLow:double,regularMarketVolume:bigint,fiftyTwoWeekHigh:double,fiftyTwoWeekLow:double,regularMarketTime:bigint>,
  indicators:struct<quote:array<struct<close:array<double>>>>>>>"""


def iso_utc(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def chart_quote(raw: DataFrame, c: str = "chart_json") -> DataFrame:
    """Quotes from chart documents; documents without a price or a symbol give no row."""
    parsed = raw.select(F.try_element_at(F.from_json(c, CHART_SCHEMA)["chart"]["result"], F.lit(1)).alias("r"))
    q = parsed.select("r.meta.*", F.filter(F.try_element_at("r.indicators.quote", F.lit(1))["close"], lambda x: x.isNotNull()).alias("closes"))
    q = q.where(F.col("regularMarketPrice").isNotNull() & T.truthy("symbol").isNotNull())
    price = F.col("regularMarketPrice")
    n = F.coalesce(F.size("closes"), F.lit(0))
    previous = F.coalesce(F.nullif("chartPreviousClose", F.lit(0.0)), F.when(n >= 2, F.try_element_at("closes", F.lit(-2))).otherwise(price))
    q = find_company(q.withColumn("previous", previous), "symbol")
    change = price - F.col("previous")
    pct = F.coalesce("regularMarketChangePercent", F.when(F.col("previous") != 0, change / F.col("previous") * 100).otherwise(0.0))
    empty = F.array().cast("array<double>")
    return q.select(
        F.col("symbol").alias("ticker"),
        F.coalesce("known.name", T.truthy("shortName"), T.truthy("longName"), "symbol").alias("name"),
        F.coalesce("known.exchange", T.truthy("fullExchangeName"), "exchangeName", F.lit("")).alias("exchange"),
        F.coalesce(T.truthy("currency"), F.lit("USD")).alias("currency"), price.alias("price"), change.alias("change"),
        pct.alias("changePercent"), F.col("previous").alias("previousClose"), F.col("regularMarketDayHigh").alias("dayHigh"),
        F.col("regularMarketDayLow").alias("dayLow"), F.col("regularMarketVolume").alias("volume"),
        F.col("fiftyTwoWeekHigh").alias("week52High"), F.col("fiftyTwoWeekLow").alias("week52Low"),
        F.coalesce(F.when(n > 60, F.slice("closes", -60, 60)).otherwise(F.col("closes")), empty).alias("spark"),
        F.coalesce("known.market", infer_market("symbol", "exchangeName")).alias("market"),
        F.coalesce(iso_utc(F.nullif("regularMarketTime", F.lit(0))), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("asOf"))


def quotes_batch(quotes: DataFrame, tickers: DataFrame) -> DataFrame:
    """Quotes of the asked tickers; unknown ones are dropped."""
    return quotes.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


SEARCH_SCHEMA = "quotes array<struct<symbol:string,quoteType:string,typeDisp:string,shortname:string,longname:string,exchDisp:string>>"


def search_tickers(raw: DataFrame, keys: list[str], c: str = "search_json") -> DataFrame:
    """Equities of ticker-search documents."""
    q = raw.select(*keys, F.posexplode(F.from_json(c, SEARCH_SCHEMA)["quotes"]).alias("pos", "q")).select(*keys, "pos", "q.*")
    equity = (F.coalesce(F.col("quoteType") == "EQUITY", F.lit(False)) | F.coalesce(F.col("typeDisp") == "Equity", F.lit(False)))
    return q.where(T.truthy("symbol").isNotNull() & equity).select(
        *keys, "pos", F.col("symbol").alias("ticker"), F.coalesce(T.truthy("shortname"), T.truthy("longname"), "symbol").alias("name"),
        F.coalesce("exchDisp", F.lit("")).alias("exchange"), infer_market("symbol", "exchDisp").alias("market"),
        F.coalesce(T.truthy("typeDisp"), F.lit("Equity")).alias("type"))
