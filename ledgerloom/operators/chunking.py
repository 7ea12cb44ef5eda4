"""Section-aware chunking of cleaned documents.

Lines become blocks inside each page with column expressions.  What follows depends
on everything emitted before it, so it is a stream over sorted rows: one shuffle by
document.  Documents with more pages than ``WHOLE_DOCUMENT_PAGES`` take another way:
blocks, sections and numbers come from scans over pieces of the document, and the
builder, which forgets everything at a level 1-2 heading and after a block that fills
a chunk by itself, runs on the stretches between those points.  So one huge document
spreads over many tasks, and both ways give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ledgerloom.functions import text as T
from ledgerloom.operators.ordered import scan_within
from ledgerloom.session import materialize

WHOLE_DOCUMENT_PAGES = 2000

MIN_TOKENS, TARGET_TOKENS, MAX_TOKENS, OVERLAP_TOKENS = 300, 800, 1200, 150

# Heading level, pattern and confidence, first match wins.
HEADING_RULES = (
    (1, r"(?iU)^PART\s+[IVXLC]+\b", 0.95),
    (2, r"(?iU)^ITEM\s+\d+[A-Z]?\.?\s", 0.95),
    (2, r"(?iU)^SECTION\s+\d+", 0.90),
    (2, r"(?iU)^SCHEDULE\s+[IVXLC\d]+", 0.85),
    (2, r"(?iU)^(?:ANNEXURE|EXHIBIT)\s+[A-Z\d]", 0.85),
    (2, r"(?U)^[A-Z][A-Z\s&,\-'/()]{4,79}$", 0.75),
    (3, r"(?iU)^Notes?\s+\d", 0.85),
    (3, r"(?U)^\d+\.\d+\.?\s+[A-Z]", 0.70),
)
# Count the groups [$₹€¥]?\\s*[\\d,]+\\.?\\d* and \\S+\\s{3,}: what may stand before does not change their number.
NUMBER_GROUP = r"[\p{Nd},]+\.?\p{Nd}*"
WIDE_GAP = r"(?U)\S\s{3,}"
HEADING_CONFIDENCE = 0.70


def estimate_tokens(c) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(T.col(c)) / 4).cast("int"))


def _heading_rule(s: Column) -> Column:
    """Number of the heading rule a trimmed line meets, null for none."""
    size = F.length(s)
    prefixed = F.startswith(s, F.lit("ITEM ")) | F.startswith(s, F.lit("PART ")) | F.startswith(s, F.lit("SECTION "))
    out = F.when((size == 0) | (size > 120) | ((size > 80) & ~prefixed), F.lit(None).cast("int"))
    for i, (_, pattern, _) in enumerate(HEADING_RULES):
        out = out.when(s.rlike(pattern), i)
    return out


def _of_rule(rule: Column, field: int, otherwise) -> Column:
    values = F.array(*[F.lit(r[field]) for r in HEADING_RULES])
    return F.coalesce(F.get(values, rule), F.lit(otherwise))


def heading_score(line: Column) -> Column:
    """struct(level, confidence) of one line; level 0 is no heading."""
    rule = _heading_rule(T.strip(line))
    return F.struct(_of_rule(rule, 0, 0).alias("level"), _of_rule(rule, 2, 0.0).alias("confidence"))


def _looks_tabular(s: Column) -> Column:
    return ((F.contains(s, F.lit("|")) & (F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit(""))) >= 2))
            | (F.regexp_count(s, F.lit(NUMBER_GROUP)) >= 3)
            | (F.regexp_count(s, F.lit(WIDE_GAP)) >= 2))


def is_table_row(line: Column) -> Column:
    s = T.strip(line)
    return (s != "") & _looks_tabular(s)


def _page_blocks(c) -> Column:
    """Blocks inside one page: array of struct(kind, level, text), and edge kinds."""
    # Bound step by step, so that no line is trimmed or searched more than once.
    trimmed = F.transform(T.lines_of(c), T.strip)
    ruled = F.transform(trimmed, lambda s: F.struct(s.alias("s"), _heading_rule(s).alias("rule")))

    def classify(x):
        heading = _of_rule(x["rule"], 2, 0.0) >= HEADING_CONFIDENCE
        kind = (F.when(x["s"] == "", "blank").when(heading, "heading")
                .when(_looks_tabular(x["s"]), "table").otherwise("paragraph"))
        return F.struct(kind.alias("kind"), _of_rule(x["rule"], 0, 0).alias("level"), x["s"].alias("s"))

    def begins(b, i):
        """Whether a block begins at line i: everything but a run of table rows or of paragraph lines."""
        same = F.get(b["l"], i)["kind"] == F.get(b["l"], i - 1)["kind"]
        return (i == 0) | ~same | ~F.get(b["l"], i)["kind"].isin("table", "paragraph")

    def block(b, start, n):
        end = F.coalesce(F.get(b["starts"], n + 1), F.size(b["l"]))
        first = F.get(b["l"], start)
        texts = F.transform(F.slice(b["l"], start + 1, end - start), lambda x: x["s"])
        return F.struct(first["kind"].alias("kind"), F.when(first["kind"] == "heading", first["level"]).otherwise(F.lit(0)).alias("level"),
                        F.array_join(texts, "\n").alias("text"))

    # Bound in an array of one element: the lines are worked out once, and each is copied once into its block.
    bound = F.transform(F.array(F.transform(ruled, classify)), lambda ls: F.struct(ls.alias("l")))
    bound = F.transform(bound, lambda b: F.struct(b["l"].alias("l"), F.filter(
        F.sequence(F.lit(0), F.size(b["l"]) - 1), lambda i: begins(b, i)).alias("starts")))
    return F.transform(bound, lambda b: F.struct(
        F.filter(F.transform(b["starts"], lambda start, n: block(b, start, n)), lambda x: x["kind"] != "blank").alias("blocks"),
        F.get(b["l"], F.lit(0))["kind"].alias("head"), F.get(b["l"], F.size(b["l"]) - 1)["kind"].alias("tail")))[0]


def page_blocks(pages: DataFrame, text: str = "clean_text") -> DataFrame:
    """``document_id, page, blocks, head, tail``: one row per page, no shuffle."""
    return (pages.select("document_id", "page", _page_blocks(text).alias("b"))
            .select("document_id", "page", "b.blocks", "b.head", "b.tail"))


def parse_blocks(pages: DataFrame, text: str = "clean_text") -> DataFrame:
    """``document_id, block_no, text, pages, block_type, heading_level``."""
    return _number_blocks(materialize(page_blocks(pages, text), "page-blocks"))


def _number_blocks(paged: DataFrame) -> DataFrame:
    """Blocks of whole documents from the written blocks of their pages.

    A block runs on over a page break unless a blank line or a heading is there, so
    pages exchange only the kind of their edge lines and their number of blocks.
    """
    p = paged.select("document_id", "page", "head", "tail", F.size("blocks").alias("n"),
                     F.expr("page div 256").alias("piece"))
    p = scan_within(p, ["document_id"], ["page"], "piece", lasts={"prev": F.col("tail")}, inclusive=False)
    runs_on = (F.col("prev") == F.col("head")) & F.col("head").isin("table", "paragraph")
    p = p.withColumn("runs_on", F.coalesce(runs_on, F.lit(False)).cast("int"))
    p = scan_within(p, ["document_id"], ["page"], "piece", sums={"before": F.col("n") - F.col("runs_on")},
                    inclusive=False)
    parts = (paged.select("document_id", "page", "blocks")
             .join(p.select("document_id", "page", "before", "runs_on"), ["document_id", "page"])
             .select("document_id", "page", "before", "runs_on", F.posexplode("blocks").alias("i", "b")))
    numbered = parts.select("document_id", (F.col("before") + F.col("i") - F.col("runs_on")).alias("block_no"),
                            "page", "b.*")
    g = numbered.groupBy("document_id", "block_no").agg(
        F.first("kind").alias("block_type"), F.max("level").alias("heading_level"),
        F.array_sort(F.collect_list(F.struct("page", "text"))).alias("parts"))
    return g.select(
        "document_id", "block_no",
        T.strip(F.array_join(F.col("parts.text"), "\n")).alias("text"),
        F.array_distinct(F.col("parts.page")).alias("pages"), "block_type", "heading_level")


def assign_sections(blocks: DataFrame) -> DataFrame:
    """Forward fill of section (level 1-2) and subsection (level 3 inside a section)."""
    blocks = materialize(blocks, "blocks")
    level = F.col("heading_level")
    major = (level > 0) & (level <= 2)
    heavy = (F.col("block_type") != "heading") & (estimate_tokens("text") >= TARGET_TOKENS)
    b = blocks.select(
        "document_id", "block_no", F.expr("block_no div 512").alias("piece"), "heading_level",
        F.when(level > 0, F.struct("block_no", "text")).alias("head"),
        major.cast("int").alias("major"), heavy.cast("int").alias("is_heavy"))
    b = scan_within(
        b, ["document_id"], ["block_no"], "piece",
        sums={"segment": F.col("major"), "heavy": F.col("is_heavy")},
        lasts={"sec": F.when(major, F.col("head")), "sub": F.when(level > 2, F.col("head"))})
    found = b.select(
        "document_id", "block_no", F.coalesce("sec.text", F.lit("")).alias("section"),
        F.when(F.col("sub.block_no") > F.coalesce("sec.block_no", F.lit(-1)), F.col("sub.text"))
        .otherwise(F.lit("")).alias("subsection"),
        # A heavy block still belongs to the stretch it ends.
        (F.col("segment") + F.col("heavy") - F.col("is_heavy")).alias("segment"))
    return blocks.join(found, ["document_id", "block_no"])


def _tokens(text: str) -> int:
    return max(1, len(text) // 4)


class _Builder:
    """Chunk accumulator for one stretch of blocks."""

    def __init__(self):
        self.parts: list[str] = []
        self.pages: set[int] = set()
        self.tokens = 0
        self.heading = self.table = False
        self.where: tuple[str, str] | None = None

    def _seal(self, carry_over: bool):
        if not self.parts:
            return
        text = "\n\n".join(self.parts)
        yield {"section": self.where[0], "subsection": self.where[1],
               "page_start": min(self.pages, default=None), "page_end": max(self.pages, default=None),
               "text": text, "token_count": _tokens(text), "has_heading": self.heading,
               "contains_table": self.table}
        tail, where = self.parts[-1], self.where
        self.__init__()
        self.where = where
        if carry_over and _tokens(tail) <= OVERLAP_TOKENS:
            self.parts, self.tokens = [tail], _tokens(tail)

    def add(self, b):
        size = _tokens(b.text)
        kind = b.block_type
        major = kind == "heading" and b.heading_level <= 2
        if major:
            yield from self._seal(False)
        elif kind == "paragraph":
            if self.tokens + size > MAX_TOKENS and self.tokens >= MIN_TOKENS:
                yield from self._seal(True)
        elif self.tokens >= MIN_TOKENS:
            yield from self._seal(True)
        if kind != "table" or self.where is None:
            self.where = (b.section, b.subsection)
        self.parts.append(b.text)
        self.pages.update(b.pages)
        self.tokens += size
        self.heading |= kind == "heading"
        self.table |= kind == "table"
        if kind != "heading" and self.tokens >= TARGET_TOKENS:
            yield from self._seal(kind == "paragraph")

    def close(self):
        yield from self._seal(False)


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def _split(chunk: dict):
    """Greedy fill of sentences up to the limit when a chunk is too long."""
    if chunk["token_count"] <= MAX_TOKENS:
        yield chunk
        return
    held, size = [], 0
    for sentence in _SENTENCE_END.split(chunk["text"]):
        n = _tokens(sentence)
        if held and size + n > MAX_TOKENS:
            text = " ".join(held)
            yield {**chunk, "text": text, "token_count": _tokens(text)}
            held, size = [], 0
        held.append(sentence)
        size += n
    text = " ".join(held)
    yield {**chunk, "text": text, "token_count": _tokens(text)}


_CHUNK_FIELDS = ("section string, subsection string, page_start int, page_end int, text string, "
                 "token_count int, has_heading boolean, contains_table boolean")
_CHUNK_COLUMNS = [f.split()[0] for f in _CHUNK_FIELDS.split(", ")]


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("page_start", "page_end"):
        out[c] = out[c].astype("Int32")
    return out


def _pieces(chunks, split: bool):
    for chunk in chunks:
        yield from (_split(chunk) if split else (chunk,))


def _chunk_stream(split: bool):
    columns = ["document_id", "segment", "idx", *_CHUNK_COLUMNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, builder, idx = None, _Builder(), 0

        def rows_of(chunks):
            nonlocal idx
            for piece in _pieces(chunks, split):
                yield {"document_id": key[0], "segment": key[1], "idx": idx, **piece}
                idx += 1

        for batch in batches:
            rows = []
            for b in batch.itertuples(index=False):
                if key != (b.document_id, b.segment):
                    if key is not None:
                        rows.extend(rows_of(builder.close()))
                    key, builder, idx = (b.document_id, b.segment), _Builder(), 0
                rows.extend(rows_of(builder.add(b)))
            yield _frame(rows, columns)
        if key is not None:
            yield _frame(list(rows_of(builder.close())), columns)

    return run


def build_chunks(blocks: DataFrame, split: bool = True) -> DataFrame:
    """Chunks of every stretch, too long ones split at sentence ends."""
    ordered = (blocks.repartition("document_id", "segment")
               .sortWithinPartitions("document_id", "segment", "block_no"))
    return ordered.mapInPandas(
        _chunk_stream(split), f"document_id string, segment long, idx long, {_CHUNK_FIELDS}")


def _absorb(held: dict, nxt: dict) -> dict:
    text = held["text"] + "\n\n" + nxt["text"]
    return {**held, "text": text, "token_count": _tokens(text),
            "page_end": nxt["page_end"] or held["page_end"],
            "has_heading": held["has_heading"] or nxt["has_heading"],
            "contains_table": held["contains_table"] or nxt["contains_table"],
            "section": held["section"] or nxt["section"],
            "subsection": nxt["subsection"] or held["subsection"]}


def _merge_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, key = None, None
    columns = ["document_id", "segment", "idx", "n_chunks", *_CHUNK_COLUMNS]
    for batch in batches:
        rows = []
        for r in batch.to_dict("records"):
            for p in ("page_start", "page_end"):
                r[p] = None if pd.isna(r[p]) else int(r[p])
            run = (r["document_id"], r["run"])
            if held is not None and run == key and held["token_count"] < MIN_TOKENS:
                held = _absorb(held, r)
                continue
            if held is not None:
                rows.append(held)
            held, key = r, run
        yield _frame(rows, columns)
    if held is not None:
        yield _frame([held], columns)


def merge_undersized(chunks: DataFrame) -> DataFrame:
    """Small chunks absorb what follows until they are large enough.

    A chunk that is large by itself always ends a merge, so the run up to and
    including it can be folded without knowing the rest of the document.
    """
    chunks = materialize(chunks, "chunks")
    slim = chunks.select("document_id", "segment", "idx", F.expr("segment div 256").alias("piece"),
                         (F.col("token_count") >= MIN_TOKENS).cast("int").alias("big"))
    runs = scan_within(slim, ["document_id"], ["segment", "idx"], "piece", sums={"run": F.col("big")},
                       inclusive=False).select("document_id", "segment", "idx", "run")
    sizes = slim.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    ordered = (chunks.join(runs.join(sizes, "document_id"), ["document_id", "segment", "idx"])
               .repartition("document_id", "run")
               .sortWithinPartitions("document_id", "run", "segment", "idx"))
    merged = ordered.mapInPandas(
        _merge_stream, f"document_id string, segment long, idx long, n_chunks long, {_CHUNK_FIELDS}")
    return merged.where(_worth_keeping()).drop("n_chunks")


def _worth_keeping() -> Column:
    return (F.col("n_chunks") == 1) | (F.col("token_count") >= 30) | (F.length(T.strip("text")) >= 100)


def quality_score() -> Column:
    n = F.col("token_count")
    score = (F.lit(0.7)
             + F.when((n >= MIN_TOKENS) & (n <= MAX_TOKENS), 0.15).when(n < 100, -0.3)
             .when(n < MIN_TOKENS, -0.1).otherwise(-0.15)
             + F.when(F.coalesce(F.col("section"), F.lit("")) != "", 0.05).otherwise(0.0)
             + F.when(F.col("has_heading"), 0.05).otherwise(0.0)
             + F.when(F.col("page_start").isNotNull(), 0.05).otherwise(0.0))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 2)


class _Block:
    __slots__ = ("text", "pages", "block_type", "heading_level", "section", "subsection")

    def __init__(self, kind, level, text, page):
        self.block_type, self.heading_level = kind, level
        self.text, self.pages = text, [page]
        self.section = self.subsection = ""


class _Document:
    """Blocks, sections, chunks and merges of one document, fed page by page; holds a block, a chunk in the making and one to merge."""

    def __init__(self):
        self.block, self.tail = None, None
        self.section = self.subsection = ""
        self.builder, self.held, self.done = _Builder(), None, 0

    def _placed(self):
        """The finished block with its section, through the builder."""
        b, self.block = self.block, None
        if b is None:
            return
        if b.block_type == "heading":
            self.section, self.subsection = (b.text, "") if b.heading_level <= 2 else (self.section, b.text)
        b.section, b.subsection = self.section, self.subsection
        b.text = b.text.strip()
        yield from self._merged(self.builder.add(b))

    def _merged(self, chunks):
        for chunk in _pieces(chunks, True):
            self.done += 1
            if self.held is not None and self.held["token_count"] < MIN_TOKENS:
                self.held = _absorb(self.held, chunk)
                continue
            before, self.held = self.held, chunk
            if before is not None:
                yield from self._kept(before, 2)

    def _kept(self, chunk, n):
        if n == 1 or chunk["token_count"] >= 30 or len(chunk["text"].strip()) >= 100:
            yield chunk

    def page(self, r):
        for i, raw in enumerate(r["blocks"]):
            runs_on = i == 0 and self.tail == r["head"] and self.tail in ("table", "paragraph")
            if runs_on and self.block is not None:
                self.block.text += "\n" + raw["text"]
                self.block.pages.append(r["page"])
                continue
            yield from self._placed()
            self.block = _Block(raw["kind"], raw["level"], raw["text"], r["page"])
        self.tail = r["tail"]

    def close(self):
        yield from self._placed()
        yield from self._merged(self.builder.close())
        if self.held is not None:
            yield from self._kept(self.held, self.done)


def _document_chunks(rows):
    """Chunks of one document from its page rows in order."""
    document = _Document()
    for r in rows:
        yield from document.page(r)
    yield from document.close()


def _document_stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["document_id", "chunk_no", *_CHUNK_COLUMNS]

    def page_rows():
        for batch in batches:
            yield from batch.to_dict("records")

    out = []
    for document, rows in groupby(page_rows(), key=lambda r: r["document_id"]):
        for number, chunk in enumerate(_document_chunks(rows), 1):
            out.append({"document_id": document, "chunk_no": number, **chunk})
            if len(out) >= 500:
                yield _frame(out, columns)
                out = []
    yield _frame(out, columns)


def _chunk_whole(paged: DataFrame) -> DataFrame:
    ordered = paged.repartition("document_id").sortWithinPartitions("document_id", "page")
    return ordered.mapInPandas(
        _document_stream, f"document_id string, chunk_no long, {_CHUNK_FIELDS}")


def _chunk_in_pieces(paged: DataFrame) -> DataFrame:
    chunks = materialize(merge_undersized(build_chunks(assign_sections(_number_blocks(paged)))), "merged")
    slim = chunks.select("document_id", "segment", "idx", F.expr("segment div 256").alias("piece"))
    numbers = scan_within(slim, ["document_id"], ["segment", "idx"], "piece", sums={"chunk_no": F.lit(1)})
    return (chunks.join(numbers.drop("piece"), ["document_id", "segment", "idx"])
            .select("document_id", F.col("chunk_no").cast("long").alias("chunk_no"), *_CHUNK_COLUMNS))


def chunk_document(pages: DataFrame, text: str = "clean_text", whole_document_pages: int = WHOLE_DOCUMENT_PAGES,
                   page_rows: DataFrame | None = None) -> DataFrame:
    """Final chunks of all documents with ids numbered in document order.

    ``page_rows`` is a cheaper table with one row per page to count, when ``pages`` is
    the result of much work.
    """
    return chunk_paged(page_blocks(pages, text), pages if page_rows is None else page_rows, whole_document_pages)


def chunk_paged(paged: DataFrame, page_rows: DataFrame, whole_document_pages: int = WHOLE_DOCUMENT_PAGES) -> DataFrame:
    """``chunk_document`` of what ``page_blocks`` gives."""
    huge = (page_rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > whole_document_pages).select("document_id"))
    if huge.isEmpty():
        chunks = _chunk_whole(paged)
    else:
        # Both ways read the blocks, and the second one several times.
        huge, paged = materialize(huge, "huge"), materialize(paged, "page-blocks")
        chunks = _chunk_whole(paged.join(huge, "document_id", "left_anti")).unionByName(
            _chunk_in_pieces(paged.join(huge, "document_id", "left_semi")))
    return chunks.select(
        F.format_string("%s_chunk_%03d", "document_id", "chunk_no").alias("chunk_id"), "document_id", "chunk_no",
        *_CHUNK_COLUMNS, quality_score().alias("quality_score"))


_TYPES = {"string": StringType(), "int": IntegerType(), "boolean": BooleanType()}


class _ChunkText:
    """Table function: page rows in, chunks out as soon as they are complete; asks for its partitioning and order itself."""

    def __init__(self):
        self.document, self.name, self.number = _Document(), None, 0

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or not {"document_id", "page", "blocks", "head", "tail"} <= set(pages.dataType.names):
            raise ValueError("chunk_text needs a table with document_id, page, blocks, head and tail, as page_blocks makes it")
        fields = [StructField("document_id", StringType()), StructField("chunk_no", LongType()),
                  *[StructField(n, _TYPES[t]) for n, t in (f.split() for f in _CHUNK_FIELDS.split(", "))]]
        return AnalyzeResult(schema=StructType(fields), partitionBy=[PartitioningColumn("document_id")], orderBy=[OrderingColumn("page")])

    def _rows(self, chunks):
        for chunk in chunks:
            self.number += 1
            yield (self.name, self.number, *[chunk[c] for c in _CHUNK_COLUMNS])

    def eval(self, row):
        self.name = row["document_id"]
        yield from self._rows(self.document.page(row.asDict(recursive=True)))

    def terminate(self):
        yield from self._rows(self.document.close())


def register(spark) -> None:
    """``chunk_text`` for SQL: ``SELECT * FROM chunk_text(TABLE(page_blocks))``."""
    spark.udtf.register("chunk_text", F.udtf(_ChunkText))


def headings(paged: DataFrame) -> DataFrame:
    """``document_id, block_no, heading_level, text`` of the headings alone, from the blocks of the pages; numbers rise, with gaps."""
    found = paged.select("document_id", "page", F.posexplode("blocks").alias("i", "b")).where(F.col("b.kind") == "heading")
    return found.select("document_id", (F.col("page").cast("long") * (1 << 32) + F.col("i")).alias("block_no"),
                        F.col("b.level").alias("heading_level"), F.col("b.text").alias("text"))


def chunk_summary(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Totals per document and its distinct level 1-2 headings in order of first use; of ``blocks`` (or ``headings``) only headings count."""
    totals = chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_chunks"), F.sum("token_count").alias("total_tokens"),
        F.round(F.avg("token_count"), 1).alias("avg_chunk_tokens"))
    heads = (blocks.where((F.col("heading_level") > 0) & (F.col("heading_level") <= 2))
             .groupBy("document_id", "text").agg(F.min("block_no").alias("at")))
    return totals.join(
        heads.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_sections"),
                                         F.min_by("text", "at").alias("first_section"),
                                         F.array_sort(F.collect_list(F.struct("at", "text")))["text"].alias("sections")),
        "document_id", "left")
