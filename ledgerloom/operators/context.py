"""Questions, answer context, citations and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import text as T

MAX_CONTEXT_TOKENS = 6000

# Question classes and their patterns, first class with a match wins.
QUESTION_PATTERNS = {
    "comparative": [r"\bcompare\b", r"\bversus\b", r"\bvs\.?\b", r"\bdifference\s+between\b",
                    r"\bcompared\s+to\b", r"\bbetter\s+than\b", r"\bworse\s+than\b"],
    "summarization": [r"\bsummar", r"\boverview\b", r"\bbrief\b", r"\bhighlight",
                      r"\bkey\s+points?\b", r"\bwhat\s+does\s+the\s+report\s+say\b"],
    "analytical": [r"\bwhy\b", r"\bhow\s+did\b", r"\bexplain\b", r"\breason",
                   r"\bcause\b", r"\bimpact\b", r"\bimplication", r"\banalyz"],
}

# Abbreviations and their expansions, applied in this order.
EXPANSIONS = (
    ("AI", "Artificial Intelligence AI Machine Learning Generative AI"),
    ("ESG", "Environmental Social Governance ESG sustainability climate"),
    ("M&A", "mergers acquisitions M&A"),
    ("CAPEX", "capital expenditure CAPEX capital spending"),
    ("OPEX", "operating expenditure OPEX operating costs"),
    ("R&D", "research development R&D innovation"),
    ("ROE", "return on equity ROE"),
    ("ROA", "return on assets ROA"),
    ("EBITDA", "EBITDA earnings before interest taxes depreciation amortization"),
    ("EPS", "earnings per share EPS"),
    ("P/E", "price to earnings PE ratio valuation"),
    ("NPL", "non-performing loans NPL bad loans asset quality"),
)

# Answer templates.
TEMPLATE_OF = {"factual": "rag_answer.txt", "analytical": "rag_answer.txt",
               "summarization": "summarize.txt", "comparative": "compare.txt"}

# Fixed value: the answer when there is no evidence.
INSUFFICIENT = ("The available documents do not contain sufficient information to answer this question. "
                "Please ensure relevant documents have been indexed for this company.")


def classify_by_patterns(c, classes: dict[str, list[str]], default: str) -> Column:
    lowered = T.strip(F.lower(T.col(c)))
    out = None
    for name, patterns in classes.items():
        hit = lowered.rlike("(?U)" + "|".join(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def classify_question(c) -> Column:
    return classify_by_patterns(c, QUESTION_PATTERNS, "factual")


def expand_query(c) -> Column:
    """First whole-word occurrence of each abbreviation, one after the other."""
    out = T.col(c)
    for short, longer in EXPANSIONS:
        out = F.regexp_replace(out, rf"(?U)^([\s\S]*?)\b{short}\b([\s\S]*)$", f"$1{longer}$2")
    return out


def source_string(pages: bool = True, unknown: str = "Unknown source",
                  fields: tuple[str, ...] = ("company", "doc_type", "year", "section")) -> Column:
    """Readable source of a hit from the parts that are present."""
    parts = [F.when(F.col("year") != 0, F.col("year").cast("string")) if f == "year" else T.truthy(f)
             for f in fields]
    if pages:
        start, end = F.col("page_start"), F.col("page_end")
        span = F.when((end != 0) & (end != start), F.concat(F.lit("Pages "), start, F.lit("–"), end)
                      ).otherwise(F.concat(F.lit("Page "), start))
        parts.append(F.when(start != 0, span))
    joined = F.concat_ws(", ", *parts)
    return F.when(joined == "", unknown).otherwise(joined)


def context_blocks(hits: DataFrame, max_tokens: int = MAX_CONTEXT_TOKENS, order: str = "position",
                   keys: list[str] | None = None) -> DataFrame:
    """Numbered blocks that fit the budget: one row per citation.

    The first block that would exceed the budget ends the context, so a block stays
    when no block up to it takes the running total past the limit.
    """
    keys = keys or ["query_id"]
    cid = T.truthy("chunk_id")
    first = Window.partitionBy(*keys, "chunk_id").orderBy(order)
    # One shuffle serves all windows; sizes are taken before it, so that who asks for no text shuffles none.
    body = T.strip("text")
    hits = hits.withColumns({"_body": body, "_size": F.length(body)}).repartition(*keys)
    unique = hits.withColumn("_n", F.row_number().over(first)).where((F.col("_n") == 1) | cid.isNull()).drop("_n")
    w = Window.partitionBy(*keys).orderBy(F.coalesce("document_id", F.lit("")), F.coalesce("page_start", F.lit(0)), order)
    head = F.concat(F.lit("["), "ref", F.lit("] "))
    b = (unique.withColumn("ref", F.row_number().over(w))
         .where(F.coalesce("_size", F.lit(0)) > 0)
         .withColumn("block", F.concat(head, "_body"))
         .withColumn("block_tokens", F.greatest(F.lit(1), F.floor((F.length(head) + F.col("_size")) / 4).cast("int"))))
    running = Window.partitionBy(*keys).orderBy("ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = b.withColumn("_total", F.sum("block_tokens").over(running))
    return b.where(F.col("_total") <= max_tokens).select(
        *keys, "ref", "chunk_id", source_string().alias("source"), "section", "page_start", "page_end", "score",
        F.substring("_body", 1, 150).alias("text_preview"), "block", "block_tokens")


def build_context(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One context text per question."""
    keys = keys or ["query_id"]
    g = blocks.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ref", "block"))).alias("b"),
        F.count(F.lit(1)).alias("chunks_used"), F.sum("block_tokens").alias("total_tokens"))
    return g.select(*keys, F.array_join(F.col("b.block"), "\n\n").alias("context_text"), "chunks_used", "total_tokens")


def confidence_columns(mean: Column, best: Column, used: Column, requested: Column) -> dict[str, Column]:
    """Weighted confidence of the scores used, and its tier; all null-safe."""
    rc, top = F.coalesce(mean, F.lit(0.0)), F.coalesce(best, F.lit(0.0))
    cc = F.when(requested > 0, F.least(F.lit(1.0), used / requested)).otherwise(F.lit(0.0))
    enough = (F.when(best.isNull(), 0.0).when(top >= 0.5, F.least(F.lit(1.0), top))
              .otherwise(top / 0.5 * 0.5))
    score = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * rc + 0.3 * cc + 0.2 * enough)), 2)
    return {
        "confidence": score,
        "tier": F.when(score >= 0.80, "high").when(score >= 0.60, "medium").when(score >= 0.40, "low")
        .otherwise("insufficient"),
        "retrieval_confidence": F.round(rc, 3), "coverage_confidence": F.round(cc, 3),
        "evidence_sufficient": score >= 0.40, "best_score": F.round(top, 3),
    }


def confidence(hits: DataFrame, contexts: DataFrame, requested: int, order: str = "position",
               keys: list[str] | None = None) -> DataFrame:
    """Confidence per question, from the first ``chunks_used`` hits in retrieval order."""
    keys = keys or ["query_id"]
    used = hits.join(contexts.select(*keys, "chunks_used"), keys).where(F.col(order) <= F.col("chunks_used"))
    # Scores have four decimals; whole units make the mean independent of row order.
    units = F.round(F.col("score") * 10000).cast("long")
    g = used.groupBy(*keys).agg((F.sum(units) / F.count(units) / 10000).alias("_mean"), F.max("score").alias("_best"),
                                F.max("chunks_used").alias("chunks_used"))
    made = confidence_columns(F.col("_mean"), F.col("_best"), F.col("chunks_used"), F.lit(requested))
    return g.select(*keys, "chunks_used", *[c.alias(n) for n, c in made.items()])


def route_evidence(c="context_text") -> Column:
    return F.when(T.blank(c), "insufficient").otherwise("answer")


def prompt_text(questions: DataFrame, templates: DataFrame) -> DataFrame:
    """Question and context put into the template of the question class.

    ``templates`` has one row per class (``question_type, template_used, template``).
    """
    joined = questions.join(templates, "question_type", "left")
    filled = F.replace(F.replace("template", F.lit("{question}"), F.col("question")),
                       F.lit("{context}"), F.coalesce("context_text", F.lit("")))
    return joined.withColumn("prompt", filled)


def templates(spark) -> DataFrame:
    """Short task texts per question class; a caller may hand in a table of its own."""
    # Own wording; the placeholders are what a template must contain.
    tasks = {
        "rag_answer.txt": "Answer the question from the numbered context only and cite the numbers used.",
        "summarize.txt": "Summarise the numbered context for the question and cite the numbers used.",
        "compare.txt": "Compare what the question names, from the numbered context only, and cite the numbers used.",
    }
    rows = [(kind, file, f"{tasks[file]}\n\nQUESTION:\n{{question}}\n\nCONTEXT:\n{{context}}\n")
            for kind, file in TEMPLATE_OF.items()]
    return spark.createDataFrame(rows, "question_type string, template_used string, template string")


def answer_record(questions: DataFrame, hits: DataFrame, blocks: DataFrame, requested: int,
                  order: str = "position") -> DataFrame:
    """Evidence row per question; questions without context get the fixed answer."""
    ctx = build_context(blocks)
    conf = confidence(hits, ctx, requested, order).drop("chunks_used")
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks_retrieved"))
    joined = questions.join(ctx, "query_id", "left").join(conf, "query_id", "left").join(n, "query_id", "left")
    # A context has at least one block, and no block is blank.
    route = F.when(F.coalesce("chunks_used", F.lit(0)) == 0, "insufficient").otherwise("answer")
    return joined.withColumns({
        "route": route,
        "answer": F.when(route == "insufficient", INSUFFICIENT),
        "chunks_used": F.coalesce("chunks_used", F.lit(0)), "chunks_retrieved": F.coalesce("chunks_retrieved", F.lit(0)),
        "confidence": F.coalesce("confidence", F.lit(0.0)), "tier": F.coalesce("tier", F.lit("insufficient")),
        "evidence_sufficient": F.coalesce("evidence_sufficient", F.lit(False))})
