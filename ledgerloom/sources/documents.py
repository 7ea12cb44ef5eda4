"""Landed document files: type, validity and text pages.

Input rows have the columns of Spark's binaryFile source (``path, length, content``),
so ``spark.read.format("binaryFile").load(landing)`` is a valid input.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType

from ledgerloom.functions import text as T

HTML_PAGE_SIZE = 4000


def read_landing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).load(path))


def scan_documents(files: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """File type by suffix, else by the first bytes; unusable files stay as failed rows.

    The binaryFile source leaves files of length zero out.  With ``expected`` (``path``)
    they, and files that are not there at all, become failed rows too.
    """
    if expected is not None:
        files = expected.select("path").distinct().join(files, "path", "left")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]*)$", 1))
    head = F.substring("content", 1, 16).cast("string")
    lead = F.ltrim(head)
    by_suffix = (F.when(suffix == ".pdf", "pdf").when(suffix.isin(".htm", ".html"), "html").when(suffix == ".json", "json"))
    sniffed = (F.when(F.startswith(head, F.lit("%PDF")), "pdf").when(F.startswith(lead, F.lit("<")), "html")
               .when(F.startswith(lead, F.lit("{")) | F.startswith(lead, F.lit("[")), "json"))
    kind = F.coalesce(by_suffix, sniffed)
    empty = F.coalesce(F.octet_length("content"), F.lit(0)) == 0
    error = (F.when(empty, F.concat(F.lit("File is empty: "), "path"))
             .when(kind.isNull(), F.concat(F.lit("Unsupported file type: "), suffix, F.lit(" ("), name, F.lit(")"))))
    return files.withColumns({
        "file_type": F.when(~empty, kind), "error": error, "success": error.isNull()})


class _TextNodes(HTMLParser):
    """Collects the stripped text nodes outside scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.held: list[str] = []
        self.hidden = 0

    def flush(self):
        text = "".join(self.held).strip()
        if text and not self.hidden:
            self.nodes.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.flush()
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        self.held.append(data)

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = handle_comment


def html_text(html: str) -> str:
    parser = _TextNodes()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n".join(parser.nodes)


def pack_pages(text: str, size: int = HTML_PAGE_SIZE) -> list[str]:
    """Consecutive lines until a page is full; what remains is the last page."""
    pages, held, n = [], [], 0
    for line in text.split("\n"):
        held.append(line)
        n += len(line) + 1
        if n >= size:
            pages.append("\n".join(held).strip())
            held, n = [], 0
    rest = "\n".join(held).strip()
    return pages + [rest] if rest else pages


# Files of any length go to Python row by row: a batch of ten thousand of them would be held several times over.
@F.udf(ArrayType(StringType()), useArrow=False)
def _html_pages(html: str | None) -> list[str] | None:
    return None if html is None else pack_pages(html_text(html))


def html_to_pages(files: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row per page of about 4000 characters: ``keys, page, text, char_count``."""
    return (files.select(*keys, F.posexplode(_html_pages(html)).alias("i", "text"))
            .select(*keys, (F.col("i") + 1).alias("page"), "text", F.length("text").alias("char_count")))


def title_case(c) -> Column:
    """Every run of letters capitalised, also after digits and signs."""
    runs = F.regexp_extract_all(T.col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"))
    return F.array_join(F.transform(
        runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.right(r, F.length(r) - 1)))), "")


def json_statement_to_text(c) -> Column:
    """Readable lines of one JSON statement; key order is kept."""
    c = T.col(c)
    pairs = F.map_entries(F.from_json(c, "map<string,variant>"))

    def line(e):
        kind = F.schema_of_variant(e["value"])
        number = F.try_variant_get(e["value"], "$", "double")
        truth = F.when(F.try_variant_get(e["value"], "$", "boolean"), 1.0).otherwise(0.0)
        shown = F.try_variant_get(e["value"], "$", "string")
        label = title_case(F.translate(e["key"], "_", " "))
        return (F.when(e["key"] == "period", F.concat(F.lit("Period: "), F.coalesce(shown, F.lit("None"))))
                .when(F.is_variant_null(e["value"]) | e["value"].isNull(), F.lit(None).cast("string"))
                .when(kind == "BOOLEAN", F.concat(label, F.lit(": "), F.format_number(truth, 2)))
                .when(kind == "STRING", F.concat(label, F.lit(": "), shown))
                .when(number.isNotNull(), F.concat(label, F.lit(": "), F.format_number(number, 2)))
                .otherwise(F.concat(label, F.lit(": "), shown)))

    items = F.from_json(c, "array<variant>")
    as_list = F.array_join(F.transform(items, lambda v: F.to_json(v, {"pretty": "true"})), "\n")
    return F.when(F.startswith(F.ltrim(c), F.lit("[")), as_list).otherwise(
        F.array_join(F.array_compact(F.transform(pairs, line)), "\n"))


def extraction_summary(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages and characters of every scanned document, failed ones included."""
    g = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_pages"), F.sum("char_count").alias("total_characters"))
    zero = F.lit(0).cast("long")
    return documents.select("document_id", "file_type", "success", "error").join(g, "document_id", "left").withColumns({
        "total_pages": F.coalesce("total_pages", zero), "total_characters": F.coalesce("total_characters", zero)})


def valid_pdf_payload(content="content", content_type="content_type") -> Column:
    """Acceptance test of a filing download."""
    kind = F.lower(F.coalesce(T.col(content_type), F.lit("")))
    return (F.contains(kind, F.lit("pdf")) & (F.octet_length(content) >= 800)
            & (F.hex(F.substring(content, 1, 4)) == "25504446"))


def valid_ir_pdf(content="content", content_type="content_type") -> Column:
    """Acceptance test of a document found on an investor page."""
    kind = F.lower(F.coalesce(T.col(content_type), F.lit("")))
    magic = F.hex(F.substring(content, 1, 5)) == "255044462D"
    return magic | (F.contains(kind, F.lit("application/pdf")) & (F.octet_length(content) > 1024))
