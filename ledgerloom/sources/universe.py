"""The curated company list and ticker rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions import text as T

# Symbol, name, exchange and sector of the curated companies, in order.
INDIA = (
    ("RELIANCE", "Reliance Industries", "Energy"), ("TCS", "Tata Consultancy Services", "IT"),
    ("HDFCBANK", "HDFC Bank", "Banks"), ("INFY", "Infosys", "IT"), ("ICICIBANK", "ICICI Bank", "Banks"),
    ("HINDUNILVR", "Hindustan Unilever", "FMCG"), ("ITC", "ITC", "FMCG"), ("SBIN", "State Bank of India", "Banks"),
    ("BHARTIARTL", "Bharti Airtel", "Telecom"), ("BAJFINANCE", "Bajaj Finance", "Financials"),
    ("KOTAKBANK", "Kotak Mahindra Bank", "Banks"), ("LT", "Larsen & Toubro", "Industrials"),
    ("AXISBANK", "Axis Bank", "Banks"), ("ASIANPAINT", "Asian Paints", "Materials"), ("MARUTI", "Maruti Suzuki", "Auto"),
    ("SUNPHARMA", "Sun Pharma", "Healthcare"), ("TITAN", "Titan Company", "Consumer"),
    ("ULTRACEMCO", "UltraTech Cement", "Materials"), ("WIPRO", "Wipro", "IT"), ("HCLTECH", "HCL Technologies", "IT"),
    ("TATAMOTORS", "Tata Motors", "Auto"), ("M&M", "Mahindra & Mahindra", "Auto"),
    ("ADANIENT", "Adani Enterprises", "Conglomerate"), ("NTPC", "NTPC", "Utilities"), ("ONGC", "ONGC", "Energy"),
    ("JSWSTEEL", "JSW Steel", "Materials"), ("NESTLEIND", "Nestle India", "FMCG"), ("POWERGRID", "Power Grid", "Utilities"),
)
UNITED_STATES = (
    ("AAPL", "Apple", "NASDAQ", "Technology"), ("MSFT", "Microsoft", "NASDAQ", "Technology"),
    ("NVDA", "NVIDIA", "NASDAQ", "Technology"), ("AMZN", "Amazon", "NASDAQ", "Consumer"),
    ("GOOGL", "Alphabet", "NASDAQ", "Technology"), ("META", "Meta Platforms", "NASDAQ", "Technology"),
    ("TSLA", "Tesla", "NASDAQ", "Auto"), ("AVGO", "Broadcom", "NASDAQ", "Technology"),
    ("JPM", "JPMorgan Chase", "NYSE", "Banks"), ("V", "Visa", "NYSE", "Financials"),
    ("UNH", "UnitedHealth", "NYSE", "Healthcare"), ("XOM", "Exxon Mobil", "NYSE", "Energy"),
    ("JNJ", "Johnson & Johnson", "NYSE", "Healthcare"), ("WMT", "Walmart", "NYSE", "Consumer"),
    ("MA", "Mastercard", "NYSE", "Financials"), ("PG", "Procter & Gamble", "NYSE", "FMCG"),
    ("COST", "Costco", "NASDAQ", "Consumer"), ("NFLX", "Netflix", "NASDAQ", "Media"),
    ("BAC", "Bank of America", "NYSE", "Banks"), ("KO", "Coca-Cola", "NYSE", "FMCG"),
    ("AMD", "AMD", "NASDAQ", "Technology"), ("ORCL", "Oracle", "NYSE", "Technology"),
    ("LLY", "Eli Lilly", "NYSE", "Healthcare"), ("HD", "Home Depot", "NYSE", "Consumer"),
    ("CRM", "Salesforce", "NYSE", "Technology"), ("DIS", "Walt Disney", "NYSE", "Media"),
)
ROWS = tuple((i, *r) for i, r in enumerate(
    [(f"{s}.NS", s, name, "IN", "NSE", sector) for s, name, sector in INDIA]
    + [(s, s, name, "US", exchange, sector) for s, name, exchange, sector in UNITED_STATES]))


def universe(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROWS), "pos int, ticker string, display string, name string, market string, "
                                             "exchange string, sector string")


def universe_keys(spark: SparkSession) -> DataFrame:
    """One row per upper-case ticker or display name: the first company in order wins."""
    u = universe(spark)
    keys = u.select("*", F.explode(F.array(F.upper("ticker"), F.upper("display"))).alias("key"))
    fields = ["ticker", "display", "name", "market", "exchange", "sector"]
    return (keys.groupBy("key").agg(F.min_by(F.struct(*fields), "pos").alias("known")))


def find_company(rows: DataFrame, ticker: str = "ticker", out: str = "known") -> DataFrame:
    """Adds the struct of the curated company, null when unknown; the list has 54 rows."""
    keys = universe_keys(rows.sparkSession).withColumnRenamed("known", out)
    return (rows.withColumn("key", F.upper(T.strip(ticker))).join(F.broadcast(keys), "key", "left").drop("key"))


def infer_market(ticker, exchange=None) -> Column:
    t = F.upper(T.col(ticker))
    e = F.upper(F.coalesce(T.col(exchange), F.lit(""))) if exchange is not None else F.lit("")
    return (F.when(t.rlike(r"\.(NS|BO)$") | e.rlike("NSE|NSI|BSE"), "IN")
            .when(e.rlike("NASDAQ|NYSE|NMS|NYQ|PCX"), "US")
            .when(t.rlike("^[A-Z]{1,6}$"), "US").otherwise("OTHER"))


def validate_ticker(ticker) -> Column:
    """Upper-case ticker, null when it is not one."""
    t = T.col(ticker)
    return F.when(t.rlike(r"^[A-Za-z0-9^.&=-]{1,24}$"), F.upper(t))


def resolve_ticker(rows: DataFrame, known: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Adds ``resolved``: as it is, or with .NS when only that symbol is known.

    ``known`` is a table of listed symbols and may be large, so the joins are left to
    the optimizer.
    """
    symbols = known.select(F.upper("symbol").alias("_s")).distinct()
    r = rows.withColumn("_t", F.upper(T.strip(ticker))).withColumn("_ns", F.concat("_t", F.lit(".NS")))
    r = r.join(symbols.select(F.col("_s").alias("_t"), F.lit(True).alias("_own")), "_t", "left")
    r = r.join(symbols.select(F.col("_s").alias("_ns"), F.lit(True).alias("_in_ns")), "_ns", "left")
    resolved = (F.when(F.contains("_t", F.lit(".")) | F.col("_own"), F.col("_t"))
                .when(F.col("_in_ns"), F.col("_ns")).otherwise(F.col("_t")))
    return r.withColumn("resolved", resolved).drop("_t", "_ns", "_own", "_in_ns")


def exchange_route(rows: DataFrame, cik: DataFrame, ticker: str = "ticker", failed: str | None = None) -> DataFrame:
    """Adds ``exchange_group``: us when in the CIK reference, else in; unknown without a ticker or where the look-up failed.

    ``failed`` names a boolean column of the rows whose look-up did not go through (null: it did); both
    exchanges are asked for those.
    """
    ref = cik.select(F.upper("ticker").alias("_t"), F.lit(True).alias("_us")).distinct()
    r = rows.withColumn("_t", F.upper(T.strip(ticker))).join(ref, "_t", "left")
    lost = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    return r.withColumn("exchange_group", F.when(lost | (F.coalesce(F.col("_t"), F.lit("")) == ""), "unknown").when(F.col("_us"), "us").otherwise("in")).drop("_t", "_us")
