"""News feeds: RSS documents and news-search JSON to items."""

from __future__ import annotations

import html
import re
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ledgerloom.functions import text as T
from ledgerloom.functions.urls import host, query_param

# Labels of the origins, and child tags of each item field.
ORIGIN_LABELS = {"google-news": "Google News", "yahoo": "Yahoo Finance", "bing": "Bing News"}
ITEM_TAGS = {"title": ("title",), "link": ("link", "guid"), "pub": ("pubdate", "published", "date"),
             "source": ("source", "creator"), "description": ("description", "summary")}
# Zone names of mail dates.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
         "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}

_CDATA = re.compile(r"<!\[CDATA\[([\s\S]*?)\]\]>")


# Texts of any length go to Python row by row: a batch of ten thousand of them would be held several times over.
@F.udf(StringType(), useArrow=False)
def _decode(text: str | None) -> str | None:
    for _ in range(3 if text else 0):
        text = html.unescape(_CDATA.sub(r"\1", text))
    return text


def decode_xml_text(c) -> Column:
    """CDATA unwrapped and entities decoded, three times over; text with neither skips Python."""
    c = T.col(c)
    marked = F.contains(c, F.lit("&")) | F.contains(c, F.lit("<![CDATA["))
    return T.strip(F.coalesce(_decode(F.when(marked, c)), c))


def strip_html(c) -> Column:
    out = decode_xml_text(c)
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?i)<{tag}[\s\S]*?</{tag}>", " ")
    return T.squeeze(F.regexp_replace(out, "<[^>]+>", " "))


def unwrap_bing(c) -> Column:
    return F.coalesce(query_param(c, "url"), T.col(c))


def source_from_title(c) -> Column:
    """struct(title, source): cut at the last ' - ' when both sides are long enough."""
    c = T.col(c)
    head = F.regexp_extract(c, r"^([\s\S]*) - ([\s\S]*)$", 1)
    tail = F.regexp_extract(c, r"^([\s\S]*) - ([\s\S]*)$", 2)
    cut = F.length(head)
    good = c.rlike(r"^[\s\S]* - [\s\S]*$") & (cut > 12) & (cut < F.length(c) - 2)
    return F.when(good, F.struct(T.strip(head).alias("title"), T.strip(tail).alias("source"))).otherwise(
        F.struct(c.alias("title"), F.lit("").alias("source")))


def clean_snippet(raw, title) -> Column:
    s = F.substring(strip_html(raw), 1, 280)
    opening = F.substring(F.lower(T.col(title)), 1, 40)
    repeats = (T.truthy(title).isNotNull() & F.startswith(F.lower(s), opening))
    return F.when(F.startswith(s, F.lit("http")) | F.contains(s, F.lit("href=")) | F.coalesce(repeats, F.lit(False)), "").otherwise(s)


def parse_news_date(c) -> Column:
    """Mail date, else ISO date; without a zone it is UTC; anything else is null."""
    c = T.strip(c)
    mail = F.regexp_replace(c, r"^[A-Za-z]{3,9},\s*", "")
    for name, offset in ZONES.items():
        mail = F.regexp_replace(mail, rf"\s{name}$", f" {offset}")
    mail = F.when(mail.rlike(r"[+-]\d{4}$"), mail).otherwise(F.concat(mail, F.lit(" +0000")))
    parsed = F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(c))
    return F.coalesce(parsed, iso)


def origin_host(c) -> Column:
    return F.regexp_replace(host(c), r"^www\.", "")


_RAW_ITEM = StructType([StructField(n, StringType()) for n in ITEM_TAGS])


@F.udf(ArrayType(_RAW_ITEM), useArrow=False)
def _items(xml: str | None) -> list[dict] | None:
    if xml is None:
        return None
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    found = []
    for item in root.iter():
        if item.tag.rpartition("}")[2].lower() == "item":
            texts = [(child.tag.rpartition("}")[2].lower(), child.text) for child in item.iter() if child.text]
            found.append({field: next((t for name, t in texts if name in tags), "") for field, tags in ITEM_TAGS.items()})
    return found


def rss_items(feeds: DataFrame, keys: list[str], c: str = "xml") -> DataFrame:
    """Items of RSS documents in document order; a malformed document has none.

    Tag search is the only Python part; every text rule is a column expression.
    """
    raw = feeds.select(*keys, F.posexplode(_items(c)).alias("pos", "i")).select(*keys, "pos", "i.*")
    texts = raw.select(*keys, "pos", strip_html("title").alias("t"), strip_html("link").alias("l"), strip_html("pub").alias("p"),
                       strip_html("source").alias("s"), "description")
    texts = texts.where(F.col("t") != "").withColumn("ts", source_from_title("t"))
    return texts.select(
        *keys, "pos", F.col("ts.title").alias("title"), unwrap_bing("l").alias("link"), parse_news_date("p").alias("published_at"),
        F.coalesce(T.truthy("s"), T.truthy("ts.source"), F.lit("News")).alias("source"), clean_snippet("description", "ts.title").alias("snippet"))


def hash_id(c) -> Column:
    return F.substring(F.md5(T.col(c)), 1, 10)


def origin_label(c) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in ORIGIN_LABELS.items() for v in pair]), T.col(c))


def to_news(items: DataFrame) -> DataFrame:
    """News rows from feed items with ``origin`` and ``market``; rows lacking title or link go."""
    kept = items.where(T.truthy("title").isNotNull() & T.truthy("link").isNotNull())
    rest = [c for c in items.columns if c not in ("title", "link", "published_at", "source", "snippet", "thumbnail", "origin", "market")]
    thumb = F.col("thumbnail") if "thumbnail" in items.columns else F.lit(None).cast("string")
    return kept.select(
        *rest, F.concat_ws("-", "origin", hash_id("link")).alias("id"), "title",
        F.coalesce(T.truthy("source"), origin_label("origin")).alias("source"), F.col("link").alias("url"), "published_at", "snippet",
        thumb.alias("thumbnail"), "origin", "market")


NEWS_SEARCH = """news array<struct<uuid:string,title:string,link:string,publisher:string,providerPublishTime:bigint,
  thumbnail:struct<resolutions:array<struct<url:string>>>>>"""


def search_news_json(raw: DataFrame, keys: list[str], c: str = "search_json") -> DataFrame:
    """News rows of search documents; ``market`` is one of the keys or added by the caller."""
    n = raw.select(*keys, F.posexplode(F.from_json(c, NEWS_SEARCH)["news"]).alias("pos", "n")).select(*keys, "pos", "n.*")
    n = n.where(T.truthy("title").isNotNull() & T.truthy("link").isNotNull())
    return n.select(
        *keys, "pos", F.concat(F.lit("yahoo-"), F.coalesce(T.truthy("uuid"), hash_id("link"))).alias("id"), "title",
        F.coalesce(T.truthy("publisher"), F.lit("Yahoo Finance")).alias("source"), F.col("link").alias("url"),
        F.timestamp_seconds(F.nullif("providerPublishTime", F.lit(0))).alias("published_at"), F.lit("").alias("snippet"),
        F.try_element_at("thumbnail.resolutions", F.lit(1))["url"].alias("thumbnail"), F.lit("yahoo").alias("origin"))
