"""Merging, relevance and selection of news per company or market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators.ordered import first_per_key, rank_within, top_per_key

MIN_FOCUSED = 4
# Name words that say nothing about a company; group order of the origins.
NAME_SKIP = ("class", "group", "inc", "corp", "ltd", "limited", "the", "and", "company")
GROUP_ORDER = ("google-news", "bing", "yahoo")


def normalize_title(c) -> Column:
    return T.squeeze(F.regexp_replace(F.lower(T.col(c)), r"(?U)[^a-z0-9\s]", " "))


def group_no(origin="origin") -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in GROUP_ORDER]), T.col(origin)).cast("int")


def unique_news(items: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """First of each normalised title in (origin, position) order, by aggregation; adds ``_group``, the origin's number."""
    titled = items.withColumn("title_key", normalize_title("title")).where(F.col("title_key") != "")
    return first_per_key(titled.withColumn("_group", group_no()), [*keys, "title_key"], [F.col("_group"), F.col(pos)]).drop("title_key")


def newest_first(news: DataFrame, keys: list[str], pos: str = "pos", limit: int | None = None) -> DataFrame:
    """Ranked by date, origin and position.

    The first ``limit`` are a top-k.  All of them are ranked over a range shuffle, so a company or market that has
    most of the news is spread over many tasks.
    """
    order = [F.desc_nulls_last("published_at"), F.col("_group"), F.col(pos)]
    ranked = top_per_key(news, keys, order, limit, "rank") if limit is not None else rank_within(news, keys, order, "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int")).drop("_group")


def merge_news(items: DataFrame, keys: list[str], pos: str = "pos", limit: int | None = None) -> DataFrame:
    """First of each normalised title in (origin, position) order, newest first, the first ``limit`` or all."""
    return newest_first(unique_news(items, keys, pos), keys, pos, limit)


def company_symbol(ticker) -> Column:
    return F.regexp_replace(T.col(ticker), r"(?i)\.(NS|BO)$", "")


def is_relevant(ticker="ticker", name="name", title="title", snippet="snippet") -> Column:
    hay = F.lower(F.concat_ws(" ", F.coalesce(T.col(title), F.lit("")), F.coalesce(T.col(snippet), F.lit(""))))
    symbol = F.lower(company_symbol(ticker))
    lowered = F.lower(T.col(name))
    words = F.filter(F.split(T.squeeze(lowered), " "), lambda w: (F.length(w) > 4) & ~w.isin(*NAME_SKIP))
    by_name = T.truthy(name).isNotNull() & (F.contains(hay, lowered) | F.exists(words, lambda w: F.contains(hay, w)))
    return ((F.length(symbol) >= 2) & F.contains(hay, symbol)) | F.coalesce(by_name, F.lit(False))


def company_query(companies: DataFrame) -> DataFrame:
    """Search text and market of each company (``ticker``, ``name`` may be null)."""
    from ledgerloom.sources.universe import find_company, infer_market
    c = find_company(companies)
    symbol = company_symbol("ticker")
    label = F.coalesce(T.truthy("name"), F.col("known.name"), symbol)
    market = F.coalesce("known.market", F.when(infer_market("ticker") == "IN", "IN").otherwise("US"))
    return c.select(*companies.columns, F.concat(F.lit('"'), label, F.lit('" OR '), symbol, F.lit(" (stock OR shares OR earnings)")).alias("query"),
                    market.alias("market"))


def collect_company_news(items: DataFrame, keys: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """News per company: relevant ones only, when there are at least four of them.

    Items carry ``ticker`` and ``name``.  The search origin is filtered before merging.
    """
    keys = keys or ["ticker", "name"]
    wanted = items.where((F.col("origin") != "yahoo") | is_relevant())
    if limit is None:
        news = unique_news(wanted, keys)
    else:
        news = merge_news(wanted, keys, limit=limit).withColumn("_group", group_no())
    news = news.withColumn("relevant", is_relevant())
    many = news.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count_if("relevant").alias("_n")).where(F.col("_n") >= MIN_FOCUSED)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    focused = news.join(many, same, "left").where(F.col("_n").isNull() | F.col("relevant")).select(*news.columns)
    return newest_first(focused.drop("rank"), keys, limit=limit)


def collect_market_news(items: DataFrame, limit: int | None = None) -> DataFrame:
    """News per market; the search origin counts for the US only."""
    return merge_news(items.where((F.col("origin") != "yahoo") | (F.col("market") == "US")), ["market"], limit=limit)


def news_sources(news: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct origins of a result in order of first appearance."""
    first = news.groupBy(*keys, "origin").agg(F.min("rank").alias("at"))
    g = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "origin"))).alias("o"))
    return g.select(*keys, F.array_join(F.col("o.origin"), ",").alias("sources"))
