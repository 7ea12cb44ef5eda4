"""Research requests: class, companies, retrieval queries and plan rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators.context import classify_by_patterns

# Request classes and their patterns, first class with a match wins.
REQUEST_PATTERNS = {
    "comparison": [r"\bcompare\b", r"\bvs\.?\b", r"\bversus\b", r"\bdifference\b",
                   r"\bbetter\s+than\b", r"\bcompared\s+to\b"],
    "risk_analysis": [r"\brisk", r"\bthreat", r"\bconcern", r"\bdanger", r"\bchallenge", r"\bvulnerab"],
    "investment_memo": [r"\binvestment\s+memo", r"\bresearch\s+report", r"\bfull\s+analysis",
                        r"\bcomplete\s+report", r"\bequity\s+research", r"\binvestment\s+thesis",
                        r"\bwrite\s+a\s+report", r"\banalyze\s+.*\s+from\s+an\s+investment"],
    "factual_query": [r"\bwhat\s+is\b", r"\bwhat\s+was\b", r"\bhow\s+much\b", r"\bcurrent\s+price\b",
                      r"\broe\b", r"\broa\b", r"\beps\b", r"\bmarket\s+cap\b", r"\brevenue\b", r"\bprofit\b"],
}

# Company names looked for as substrings, in this order.
KNOWN_COMPANIES = (
    ("tcs", "TCS"), ("infosys", "INFY"), ("infy", "INFY"), ("wipro", "WIPRO"), ("reliance", "RELIANCE"),
    ("hdfc", "HDFCBANK"), ("apple", "AAPL"), ("aapl", "AAPL"), ("google", "GOOGL"), ("googl", "GOOGL"),
    ("microsoft", "MSFT"), ("msft", "MSFT"), ("tesla", "TSLA"), ("tsla", "TSLA"), ("amazon", "AMZN"),
    ("amzn", "AMZN"), ("hcltech", "HCLTECH"), ("hcl", "HCLTECH"),
)

# Capital words that are not tickers.
TICKER_STOPWORDS = (
    "AI", "IT", "US", "UK", "EU", "CEO", "CFO", "CTO", "ROE", "ROA", "EPS", "FCF", "IPO", "ESG", "PE", "PEG",
    "DCF", "SEC", "WHAT", "THE", "AND", "FOR", "FROM", "HOW", "WHY", "NOT", "ARE", "WAS",
)

# Retrieval query texts per request class.
QUERY_TEMPLATES = {
    "company_analysis": ("{company} business overview revenue operations", "{company} financial performance growth",
                         "{company} risk factors challenges", "{company} strategy growth opportunities"),
    "risk_analysis": ("{company} risk factors regulatory compliance", "{company} cybersecurity threats vulnerabilities",
                      "{company} competitive risks market threats", "{company} financial risks debt exposure"),
    "investment_memo": ("{company} business overview revenue model", "{company} financial performance margins profitability",
                        "{company} risk factors", "{company} growth strategy AI digital transformation",
                        "{company} competitive position market share"),
    "comparison": ("{company} financial performance revenue margins", "{company} growth strategy competitive position"),
}
DEFAULT_TEMPLATES = ("{company} overview",)


def classify_request(c) -> Column:
    return classify_by_patterns(c, REQUEST_PATTERNS, "company_analysis")


def extract_companies(c) -> Column:
    """Tickers of known names, then other capital words of 2 to 5 letters, each once."""
    c = T.col(c)
    lowered = F.lower(c)
    known = F.array_compact(F.array(*[
        F.when(F.contains(lowered, F.lit(name)), ticker) for name, ticker in KNOWN_COMPANIES]))
    words = F.regexp_extract_all(c, F.lit(r"(?U)\b([A-Z]{2,5})\b"))
    tickers = F.filter(words, lambda w: ~w.isin(*TICKER_STOPWORDS))
    return F.array_distinct(F.concat(known, tickers))


def generate_queries(request_type, companies) -> Column:
    """Every company put into every template of the class, company by company."""
    def for_type(templates):
        return F.flatten(F.transform(T.col(companies), lambda company: F.array(*[
            F.replace(F.lit(t), F.lit("{company}"), company) for t in templates])))

    out = None
    for name, templates in QUERY_TEMPLATES.items():
        made, hit = for_type(templates), T.col(request_type) == name
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return out.otherwise(for_type(DEFAULT_TEMPLATES))


def create_plan(requests: DataFrame) -> DataFrame:
    """Plan rows; ``companies`` of the input, when present and not null, overrides detection."""
    kind = classify_request("request")
    found = extract_companies("request")
    if "companies" in requests.columns:
        found = F.coalesce("companies", found)
    planned = requests.withColumns({"request_type": kind, "companies": found})
    return planned.withColumns({
        "plan_id": F.concat(F.lit("REQ-"), F.upper(F.substring(F.md5(F.concat_ws("|", "request_id", "request")), 1, 8))),
        "retrieval_queries": generate_queries("request_type", "companies"),
        "output_format": F.when(F.col("request_type") == "factual_query", "brief_answer").otherwise("research_report")})


def planned_companies(plans: DataFrame) -> DataFrame:
    """One row per planned company, with its position in the plan."""
    return plans.select("request_id", F.posexplode("companies").alias("pos", "ticker"))


def gather_market(plans: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshot of every planned company; a company without one keeps an error row."""
    joined = planned_companies(plans).join(snapshots.withColumn("_known", F.lit(True)), "ticker", "left")
    return joined.withColumn("error", F.when(F.col("_known").isNull(), "no market data")).drop("_known")


def gather_news(plans: DataFrame, news: DataFrame, per_company: int) -> DataFrame:
    """The first ``per_company`` news of every planned company: ``request_id, pos, news_pos, title, ...``."""
    from ledgerloom.operators.ordered import top_per_key
    first = top_per_key(news, ["ticker"], [F.col("pos"), F.col("title")], per_company, "news_pos").drop("pos")
    return planned_companies(plans).join(first, "ticker")


def gather_all_news(plans: DataFrame, news: DataFrame) -> DataFrame:
    """All news of the planned companies, each news once: ``request_id, pos, ticker, news_pos, ...``.

    A row with a request says that it asks for the news of a company; a row without one is a news of that company.
    Their join by ``ticker`` has a row for each request and news and grows with the square, so it is left to the reader.
    """
    from ledgerloom.operators.ordered import rank_within
    asked = planned_companies(plans)
    wanted = news.join(asked.select("ticker").distinct(), "ticker", "left_semi")
    ranked = rank_within(wanted, ["ticker"], [F.col("pos"), F.col("title")], "news_pos").drop("pos")
    return (asked.join(news.select("ticker").distinct(), "ticker", "left_semi")
            .unionByName(ranked.withColumns({"request_id": F.lit(None).cast("string"), "pos": F.lit(None).cast("int")}), allowMissingColumns=True))


def run_engine(plans: DataFrame, metrics: DataFrame, health: DataFrame) -> DataFrame:
    """Metric counts and health of every planned company, an error row where unknown.

    ``metrics`` and ``health`` have one row per ``ticker``.
    """
    joined = (planned_companies(plans).join(metrics, "ticker", "left").join(health, "ticker", "left"))
    return joined.withColumn("error", F.when(F.col("computed").isNull(), "no financial data"))


def request_peers(plans: DataFrame, long: DataFrame) -> DataFrame:
    """``request_id, metric, rank, ticker, value``: the companies of each request with two or more of them, ranked per metric.

    ``long`` has one row per ``ticker`` and metric; a company without a value has no rank.  A group is the
    companies named in one request, so a window over it is small.
    """
    from ledgerloom.operators.peers import LOWER_IS_BETTER
    asked = planned_companies(plans.where(F.size("companies") > 1)).withColumnRenamed("pos", "named")
    valued = asked.join(long.where(F.col("value").isNotNull()).select("ticker", "metric", "value"), "ticker")
    signed = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    place = F.row_number().over(Window.partitionBy("request_id", "metric").orderBy(signed, "named"))
    return valued.select("request_id", "metric", place.alias("rank"), "ticker", "value")


def execution_trace(plans: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """``request_id, step, tool, status, items, errors``: what each source gave each request.

    ``results`` names the rows of every source (``request_id`` and, where a row can fail, ``error``).  Retrieval
    without queries and a comparison of fewer than two companies are skipped; a request without rows has zero items.
    """
    tools = list(results)
    counted = None
    for tool, rows in results.items():
        failed = F.col("error").isNotNull() if "error" in rows.columns else F.lit(False)
        part = rows.select("request_id", F.lit(tool).alias("tool"), failed.alias("failed"))
        counted = part if counted is None else counted.unionByName(part)
    counted = counted.groupBy("request_id", "tool").agg(F.count_if(~F.col("failed")).alias("items"), F.count_if("failed").alias("errors"))
    asked = plans.select("request_id", F.size("companies").alias("_companies"), F.size("retrieval_queries").alias("_queries"),
                         F.posexplode(F.array(*[F.lit(t) for t in tools])).alias("step", "tool"))
    skipped = ((F.col("tool") == "retriever") & (F.col("_queries") == 0)) | ((F.col("tool") == "peer_comparison") & (F.col("_companies") < 2))
    return asked.join(counted, ["request_id", "tool"], "left").select(
        "request_id", "step", "tool", F.when(skipped, "skipped").otherwise("success").alias("status"),
        F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("errors", F.lit(0)).alias("errors"))


def assemble_evidence(plans: DataFrame, companies: DataFrame, engine: DataFrame, market: DataFrame,
                      chunks: DataFrame, news: DataFrame, peers: DataFrame | None = None) -> DataFrame:
    """Evidence package per request around its first company.

    ``companies`` has ticker, name, sector; ``engine`` and ``market`` one row per
    planned company; ``chunks`` (request_id, pos, ...) and ``news`` (request_id, pos,
    news_pos, ...) one row per item.  The package holds the items themselves, as arrays of
    structs in their order: what was retrieved for one request, so bounded by its top-k.  ``peers``,
    the rows of ``request_peers``, give ``peer_comparison``, an empty array where there is none.
    """
    base = plans.select("request_id", "request_type", F.coalesce(F.try_element_at("companies", F.lit(1)), F.lit("UNKNOWN")).alias("ticker"))
    def items(rows, order, name):
        rest = [c for c in rows.columns if c not in ("request_id", *order)]
        return rows.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))

    n_chunks = items(chunks, ["pos"], "chunks").withColumn("retrieved", F.size("chunks").cast("long"))
    n_news = items(news, ["pos", "news_pos"], "news_items").withColumn("news", F.size("news_items").cast("long"))
    main = engine.where("pos = 0").drop("pos", "ticker", "error")
    price = market.where("pos = 0").select("request_id", "current_price", "market_cap")
    info = companies.select("ticker", "name", "sector")
    out = (base.join(info, "ticker", "left").join(main, "request_id", "left").join(price, "request_id", "left")
           .join(n_chunks, "request_id", "left").join(n_news, "request_id", "left"))
    if peers is not None:
        ranked = items(peers.select("request_id", "metric", "rank", "ticker", "value"), ["metric", "rank"], "peer_comparison")
        out = out.join(ranked, "request_id", "left").withColumn("peer_comparison", F.coalesce("peer_comparison", F.array()))
    return out.withColumns({
        "name": F.coalesce(T.truthy("name"), "ticker"), "sector": F.coalesce(T.truthy("sector"), F.lit("Unknown")),
        "retrieved": F.coalesce("retrieved", F.lit(0)), "news": F.coalesce("news", F.lit(0))})
