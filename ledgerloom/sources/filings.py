"""Exchange filings from landed JSON and HTML, and the choice of what to store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators.ordered import first_per_key, last_per_key, top_per_key
from ledgerloom.session import materialize

ARCHIVES = "https://www.sec.gov/Archives/edgar/data"
# Form types and the document types they become.
FORM_TYPES = {"10-K": "annual_report", "10-K/A": "annual_report", "20-F": "annual_report", "10-Q": "quarterly_report",
              "10-Q/A": "quarterly_report", "8-K": "announcement", "8-K/A": "announcement"}
ANNUAL_FORMS, QUARTERLY_FORMS = ("10-K", "10-K/A", "20-F"), ("10-Q", "10-Q/A")
KINDS = ("annual_reports", "quarterly_reports", "announcements")
DOC_TYPE_OF_KIND = {"annual_reports": "annual_report", "quarterly_reports": "quarterly_report", "announcements": "announcement"}


def load_cik_reference(raw: DataFrame, c: str = "json", order: str = "file_no") -> DataFrame:
    """ticker, cik (ten digits), name; the last entry of a ticker wins."""
    entries = F.map_values(F.from_json(c, "map<string,struct<cik_str:bigint,ticker:string,title:string>>"))
    rows = raw.select(order, F.posexplode(entries).alias("pos", "e")).select(
        order, "pos", F.upper("e.ticker").alias("ticker"), F.lpad(F.col("e.cik_str").cast("string"), 10, "0").alias("cik"),
        F.col("e.title").alias("name"))
    return last_per_key(rows, ["ticker"], [F.col(order), F.col("pos")]).select("ticker", "cik", "name")


def resolve_cik(tickers: DataFrame, reference: DataFrame) -> DataFrame:
    """Adds cik, name and ``found`` to asked tickers; an unknown one keeps its row."""
    asked = tickers.withColumn("ticker", F.upper(T.strip("ticker")))
    return asked.join(reference, "ticker", "left").withColumn("found", F.col("cik").isNotNull())


SUBMISSIONS = """filings struct<recent:struct<form:array<string>,filingDate:array<string>,reportDate:array<string>,
  accessionNumber:array<string>,primaryDocument:array<string>,primaryDocDescription:array<string>>>"""


def flatten_submissions(raw: DataFrame, forms: tuple[str, ...] = tuple(FORM_TYPES), limit: int | None = None,
                        order: tuple[str, ...] = ("file_no",), c: str = "json") -> DataFrame:
    """Filing rows from column arrays: the first ``limit``, or all, of each form per CIK in source order."""
    r = raw.select("cik", *order, F.from_json(c, SUBMISSIONS)["filings"]["recent"].alias("r"))
    zipped = F.arrays_zip(*[F.col(f"r.{n}").alias(n) for n in (
        "form", "filingDate", "reportDate", "accessionNumber", "primaryDocument", "primaryDocDescription")])
    rows = r.select("cik", *order, F.posexplode(zipped).alias("pos", "f")).select("cik", *order, "pos", "f.*")
    kept = top_per_key(rows.where(F.col("form").isin(*forms)), ["cik", "form"], [*[F.col(o) for o in order], F.col("pos")], limit, "form_rank")
    mapping = F.create_map(*[F.lit(v) for pair in FORM_TYPES.items() for v in pair])
    return kept.select(
        "cik", "form", "form_rank", F.col("filingDate").alias("filing_date"), F.col("reportDate").alias("report_date"),
        F.col("accessionNumber").alias("accession"), F.col("primaryDocument").alias("primary_doc"),
        F.coalesce("primaryDocDescription", F.lit("")).alias("primary_doc_description"),
        F.concat_ws("/", F.lit(ARCHIVES), F.regexp_replace("cik", "^0+", ""), F.replace("accessionNumber", F.lit("-"), F.lit("")), "primaryDocument").alias("doc_url"),
        F.coalesce(F.try_element_at(mapping, "form"), F.lit("announcement")).alias("doc_type"))


def annual_filings(raw: DataFrame, limit: int | None = None, **kw) -> DataFrame:
    return flatten_submissions(raw, ANNUAL_FORMS, limit, **kw)


def quarterly_filings(raw: DataFrame, limit: int | None = None, **kw) -> DataFrame:
    return flatten_submissions(raw, QUARTERLY_FORMS, limit, **kw)


FACTS = "facts map<string,map<string,struct<label:string,units:map<string,array<struct<end:string,val:double,fy:int,form:string>>>>>>"


def xbrl_company_facts(raw: DataFrame, c: str = "json") -> DataFrame:
    """One row per reported fact: cik, taxonomy, concept, unit, end, val, fy, form."""
    f = raw.select("cik", F.explode(F.from_json(c, FACTS)["facts"]).alias("taxonomy", "concepts"))
    f = f.select("cik", "taxonomy", F.explode("concepts").alias("concept", "body"))
    f = f.select("cik", "taxonomy", "concept", F.explode("body.units").alias("unit", "points"))
    return f.select("cik", "taxonomy", "concept", "unit", F.inline("points"))


ANNOUNCEMENTS = """Table array<struct<NEWSID:string,HEADLINE:string,NEWSSUB:string,CATEGORYNAME:string,SUBCATNAME:string,ATTACHMENTNAME:string,
  PDFFLAG:string,DissemDT:string,DT_TM:string,NEWS_DT:string>>, Table1 array<struct<ROWCNT:bigint>>"""


def load_announcements(raw: DataFrame, max_pages: int | None = None, c: str = "json") -> DataFrame:
    """Rows of the announcement pages a reader would ask for.

    A page is read while every page before it had rows and their total stayed below
    the row count that page stated; with ``max_pages`` only so many are asked for.
    """
    from pyspark.sql import Window
    p = ((raw if max_pages is None else raw.where(F.col("page") <= max_pages))
         .select("scrip", "page", F.from_json(c, ANNOUNCEMENTS).alias("j"))
         .select("scrip", "page", F.coalesce("j.Table", F.array()).alias("rows"), F.try_element_at("j.Table1", F.lit(1))["ROWCNT"].alias("stated")))
    p = p.withColumn("n", F.size("rows"))
    w = Window.partitionBy("scrip").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("scrip").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("so_far", F.sum("n").over(w))
    stops = (F.col("n") == 0) | (F.col("so_far") >= F.coalesce("stated", F.col("n")))
    p = p.withColumn("stopped", F.coalesce(F.max(stops.cast("int")).over(back), F.lit(0)))
    return p.where("stopped = 0").select("scrip", "page", F.posexplode("rows").alias("i", "a")).select("scrip", "page", "i", "a.*")


_HIT = (r"(?is)liclick\('(\d+)','([^']+)'\).*?<strong>([^<]*)</strong>&nbsp;&nbsp;&nbsp;([^<&]+)&nbsp;&nbsp;&nbsp;\d+")
_HIT_SHORT = r"(?is)liclick\('(\d+)','([^']+)'\)"


def parse_company_search(raw: DataFrame, limit: int | None = None, c: str = "html") -> DataFrame:
    """Companies in search answers: ``query, rank, code, name, symbol, isin``."""
    def found(pattern, groups):
        return F.arrays_zip(*[F.regexp_extract_all(T.col(c), F.lit(pattern), F.lit(g)).alias(n) for g, n in groups])

    full = found(_HIT, ((1, "code"), (2, "name"), (3, "symbol"), (4, "isin")))
    short = F.transform(found(_HIT_SHORT, ((1, "code"), (2, "name"))), lambda x: F.struct(
        x["code"].alias("code"), x["name"].alias("name"), x["code"].alias("symbol"), F.lit("").alias("isin")))
    hits = F.when(F.size(full) > 0, full).otherwise(short)
    rows = (raw.where(F.length(T.strip("query")) >= 2).select("query", F.posexplode(hits).alias("pos", "h"))
            .select("query", "pos", "h.*"))
    first = first_per_key(rows, ["query", "code"], [F.col("pos")])
    kept = top_per_key(first, ["query"], [F.col("pos")], limit, "rank")
    return kept.select("query", "rank", "code", T.strip("name").alias("name"),
                       F.coalesce(T.truthy(T.strip("symbol")), "code").alias("symbol"), T.strip("isin").alias("isin"))


# --- names -----------------------------------------------------------------------

def slug(c, maximum: int = 72) -> Column:
    s = F.regexp_replace(F.replace(T.col(c), F.lit("&"), F.lit("and")), "[^a-zA-Z0-9._-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")
    return F.coalesce(T.truthy(F.substring(s, 1, maximum)), F.lit("file"))


def company_folder_name(code, symbol) -> Column:
    return F.upper(slug(F.coalesce(T.truthy(symbol), T.col(code).cast("string"))))


def clean_attachment_name(c) -> Column:
    return F.regexp_replace(T.strip(F.ltrim(T.col(c), F.lit("\\"))), r"(?i)\.pdf\.pdf$", ".pdf")


def unique_file_name(date, headline, attachment) -> Column:
    day = F.coalesce(T.truthy(F.substring(F.coalesce(T.col(date), F.lit("")), 1, 10)), F.lit("undated"))
    base = slug(F.coalesce(T.truthy(headline), F.lit("filing")), 52)
    tail = F.right(slug(F.regexp_replace(T.col(attachment), r"(?i)\.pdf$", ""), 16), F.lit(12))
    return F.concat(day, F.lit("_"), base, F.lit("_"), tail, F.lit(".pdf"))


def document_id(ticker, doc_type, year, quarter=None, source=None) -> Column:
    parts = [F.upper(T.col(ticker)), T.col(doc_type), T.col(year).cast("string")]
    parts += [T.truthy(x) for x in (quarter, source) if x is not None]
    return F.concat_ws("_", *parts)


def quarter_of(report_date) -> Column:
    """Q1..Q4 of an ISO date text, null when there is none."""
    month = F.try_to_number(F.substring(T.col(report_date), 6, 2), F.lit("99")).cast("int")
    return F.when(month.isNotNull(), F.concat(F.lit("Q"), F.floor((month - 1) / 3 + 1).cast("string")))


def headline() -> Column:
    return F.coalesce(T.truthy(T.squeeze(F.coalesce(T.truthy("HEADLINE"), T.truthy("NEWSSUB"), F.lit("Filing")))), F.lit(""))


# --- choice of filings -------------------------------------------------------------

def _cut(rows: DataFrame, limit: int) -> DataFrame:
    """Rows up to the one with which ``limit`` files are saved, per company."""
    saved = top_per_key(rows.where("saved"), ["scrip"], [F.col("pos")], limit)
    ends = saved.groupBy("scrip").agg(F.count(F.lit(1)).alias("_n"), F.max("pos").alias("_end"))
    return (rows.join(ends, "scrip", "left")
            .where((F.coalesce("_n", F.lit(0)) < limit) | (F.col("pos") <= F.col("_end"))).drop("_n", "_end"))


def select_filings(annual: DataFrame, announcements: DataFrame, payloads: DataFrame, as_of,
                   annual_limit: int = 3, quarterly_limit: int = 8, announcement_limit: int = 20,
                   announcement_days: int = 90, quarterly_days: int = 900) -> DataFrame:
    """Stored-file rows of every company: which filings are taken and which of them were saved.

    ``annual``: scrip, pos, year, file_name; ``announcements``: scrip, pos, filed_on and
    the announcement fields; ``payloads``: scrip, attachment, bytes of valid landed PDFs.
    An attachment taken by an earlier kind is not taken again.  Limits count saved files,
    found by a top-k, so a company with very many filings is not gathered in one task.
    """
    when = F.coalesce(T.truthy("DissemDT"), T.truthy("DT_TM"), T.truthy("NEWS_DT"), F.lit(""))
    fields = ["scrip", "pos", "attachment", "file_name", "title", "category", "subcategory", "news_id", "disseminated_at"]

    def with_payload(rows):
        return (rows.select(*fields).join(payloads.select("scrip", "attachment", "bytes"), ["scrip", "attachment"], "left")
                .withColumn("saved", F.col("bytes").isNotNull()))

    years = last_per_key(annual.where(T.truthy(F.col("year").cast("string")).isNotNull()).withColumn("year", F.col("year").cast("string")),
                         ["scrip", "year"], [F.col("pos")])
    best = top_per_key(years, ["scrip"], [F.desc("year")], annual_limit, "_rn").withColumn("attachment", clean_attachment_name("file_name"))
    a = best.where(F.col("attachment") != "").select(
        "scrip", F.col("_rn").cast("long").alias("pos"), "attachment", F.concat(F.lit("FY-"), "year", F.lit("_Annual-Report.pdf")).alias("file_name"),
        F.lit("Filing").alias("title"), F.lit("").alias("category"), F.lit("").alias("subcategory"), F.col("attachment").alias("news_id"),
        F.lit("").alias("disseminated_at"))
    # Each kind is read several times below (seen attachments, result), hence the written stages.
    a = materialize(with_payload(a).withColumn("kind", F.lit(KINDS[0])), "annual")

    n = announcements.withColumns({
        "attachment": clean_attachment_name(F.coalesce("ATTACHMENTNAME", F.lit(""))), "title": headline(), "disseminated_at": when,
        "category": F.coalesce("CATEGORYNAME", F.lit("")), "subcategory": F.coalesce("SUBCATNAME", F.lit(""))})
    n = n.withColumn("news_id", F.coalesce(T.truthy("NEWSID"), "attachment"))
    n = n.where((F.col("PDFFLAG") == "1") & (F.col("attachment") != ""))

    def unseen(rows, seen):
        first = first_per_key(rows, ["scrip", "attachment"], [F.col("pos")])
        return first.join(seen.select("scrip", "attachment").distinct(), ["scrip", "attachment"], "left_anti")

    q = n.where((F.col("category") == "Result") & (F.col("filed_on") >= F.date_sub(F.lit(as_of), quarterly_days)))
    q = q.withColumn("file_name", unique_file_name("disseminated_at", "title", "attachment"))
    q = _cut(materialize(with_payload(unseen(q, a)), "candidates"), quarterly_limit).withColumn("kind", F.lit(KINDS[1]))
    q = materialize(q, "quarterly")

    lowered = F.lower("category")
    m = n.where((F.col("filed_on") >= F.date_sub(F.lit(as_of), announcement_days)) & (lowered != "result")
                & ~(F.contains(F.lower("title"), F.lit("annual report")) & F.contains(lowered, F.lit("update"))))
    m = m.withColumn("file_name", unique_file_name(
        "disseminated_at", F.concat_ws("-", F.coalesce(T.truthy("subcategory"), F.lit("General")), "title"), "attachment"))
    seen = a.select("scrip", "attachment").unionByName(q.select("scrip", "attachment"))
    m = _cut(materialize(with_payload(unseen(m, seen)), "candidates"), announcement_limit).withColumn("kind", F.lit(KINDS[2]))

    every = a.unionByName(q).unionByName(m)
    return every.withColumns({
        "bytes": F.coalesce("bytes", F.lit(0).cast("long")),
        "skipped": F.when(~F.col("saved"), "PDF not available on BSE")}).withColumnRenamed("title", "headline")


def filing_counts(files: DataFrame, keys: list[str]) -> DataFrame:
    """Saved files per kind and their bytes, per company."""
    return files.groupBy(*keys).agg(
        *[F.count_if(F.col("saved") & (F.col("kind") == k)).alias(k) for k in KINDS],
        F.sum(F.when(F.col("saved"), F.col("bytes")).otherwise(F.lit(0))).alias("total_bytes"))


def sec_stored_files(filings: DataFrame, payloads: DataFrame) -> DataFrame:
    """Filing rows as stored files; filings without a landed payload are failures."""
    kind = (F.when(F.col("form").isin(*ANNUAL_FORMS), KINDS[0]).when(F.col("form").isin(*QUARTERLY_FORMS), KINDS[1])
            .otherwise(KINDS[2]))
    joined = filings.join(payloads.select("cik", "accession", "bytes"), ["cik", "accession"], "left")
    return joined.select(
        "cik", kind.alias("kind"), F.col("primary_doc").alias("file_name"),
        F.coalesce(T.truthy("primary_doc_description"), "form").alias("headline"), F.col("form").alias("category"),
        F.lit("SEC Filing").alias("subcategory"), F.col("accession").alias("news_id"), F.col("filing_date").alias("disseminated_at"),
        F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"), F.col("bytes").isNotNull().alias("saved"))


# --- manifests ---------------------------------------------------------------------

def manifests(files: DataFrame, companies: DataFrame, keys: str = "scrip") -> DataFrame:
    """One manifest row per company: folder, counts and total bytes beside its identity."""
    return companies.join(filing_counts(files, [keys]), keys).withColumn("folder", company_folder_name(keys, "symbol"))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").partitionBy("folder").json(path)


def read_manifests(spark: SparkSession, path: str, folders: DataFrame, schema) -> DataFrame:
    """Manifests of the listed folders; a folder without one becomes an empty manifest."""
    found = spark.read.schema(schema).json(path)
    code = F.regexp_extract("folder", "^([^-]*)", 1)
    symbol = F.when(F.contains("folder", F.lit("-")), F.regexp_replace("folder", "^[^-]*-", "")).otherwise(F.col("folder"))
    zero = F.lit(0).cast("long")
    joined = folders.select("folder").distinct().join(found.withColumn("_has", F.lit(True)), "folder", "left")
    own = F.col("_has").isNotNull()
    return joined.select(
        "folder", F.when(own, F.col("scrip")).otherwise(code).alias("scrip"), F.when(own, F.col("symbol")).otherwise(symbol).alias("symbol"),
        F.when(own, F.col("fetched_at")).otherwise("").alias("fetched_at"),
        *[F.coalesce(k, zero).alias(k) for k in (*KINDS, "total_bytes")])
