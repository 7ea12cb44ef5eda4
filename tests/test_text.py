from __future__ import annotations

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import chunking as K
from ledgerloom.operators import cleaning as C


def one(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.o for r in df.select("i", column("text").alias("o")).orderBy("i").collect()]


def test_unicode_and_control(spark):
    assert one(spark, C.normalize_unicode, "café", "plain", None) == ["café", "plain", None]
    assert one(spark, C.remove_control_characters, "a\x00b​c\td\ne­f\x7f") == ["abc\td\nef"]


def test_artifacts_and_page_numbers(spark):
    raw = "http://fasb.org/x\nRevenue\n0000320193\nTRUE\nP1Y\n\naapl-20250927\n1234567890\nhttps://a.b/c d"
    assert one(spark, C.remove_xbrl_artifacts, raw) == ["Revenue\n\nhttps://a.b/c d"]
    assert one(spark, C.remove_page_numbers, "154\n- 12 -\nPage 3 of 9\nxiv\nmix\nRevenue 154\n12345") == ["Revenue 154\n12345"]


def test_whitespace_and_paragraphs(spark):
    assert one(spark, C.normalize_whitespace, "a\t b   c  \n\n  d ") == ["a b c\n\n d"]
    assert one(spark, C.normalize_paragraphs, "\n\na\n\n\n\n\n\nb\n\nc \n") == ["a\n\n\nb\n\nc"]


@pytest.mark.parametrize("text, expected", [
    ("Revenue increased by this much\n14% due to strong\ncloud demand.", "Revenue increased by this much\n14% due to strong\ncloud demand."),
    ("Revenue increased strongly by\nfourteen percent due to\ncloud demand.", "Revenue increased strongly by fourteen percent due to cloud demand."),
    ("The company kept oper-\nating its plants well", "The company kept operating its plants well"),
    ("The first sentence ends here.\nlower start", "The first sentence ends here.\nlower start"),
    ("Short line\nlower start", "Short line\nlower start"),
    ("A long enough first line here\n- bullet item", "A long enough first line here\n- bullet item"),
    ("Sales 10 20 30 in this table row\nlower start", "Sales 10 20 30 in this table row\nlower start"),
    ("A line with 10 and 20 in the text\nmore text 30 here and\nstill lower", "A line with 10 and 20 in the text more text 30 here and\nstill lower"),
])
def test_broken_lines(spark, text, expected):
    assert one(spark, C.fix_broken_lines, text) == [expected]


def test_repeated_lines(spark):
    rows = [("d", p, f"ACME Corp 2024\nBody {chr(97 + p % 26)}{p * 'x'}\nmore text {p * 'y'}\nPage {p}") for p in range(1, 31)]
    rows += [("small", p, "Same head\nbody") for p in range(4)]
    pages = spark.createDataFrame(rows, "document_id string, page int, text string")
    got = {(r.document_id, r.side, r.pattern): r.hits for r in C.repeated_lines(pages).collect()}
    assert got == {("d", "header", "ACME Corp #"): 30, ("d", "footer", "Page #"): 30}
    cleaned = {(r.document_id, r.page): r.clean_text for r in C.clean_document(pages).collect()}
    assert cleaned["d", 1] == "Body bx\nmore text y"
    assert cleaned["small", 0] == "Same head\nbody"


def test_a_digit_line_counts_each_time(spark):
    pages = spark.createDataFrame([("d", p, "Item 7\nItem 8\nplain\nplain\nend") for p in range(5)], "document_id string, page int, text string")
    got = {r.pattern: r.hits for r in C.repeated_lines(pages).where("side = 'header'").collect()}
    assert got == {"Item #": 10, "plain": 5}


def test_long_page_folds(spark):
    """Pieces of the fold meet without a seam, and a block keeps all its lines."""
    lines = [("and this text goes on with the words of the com-" if i % 7 else "Total revenue of the whole group in the year 12,") for i in range(3 * C.FOLD_PIECE + 5)]
    done, groups = [lines[0]], 1
    for line in lines[1:]:
        if line[0] == "a" and groups < 3:
            done[-1] = done[-1][:-1] + line if done[-1].endswith("-") else done[-1] + " " + line
        else:
            done.append(line)
            groups = 1 if line[0] == "T" else 0
    assert one(spark, C.fix_broken_lines, "\n".join(lines)) == ["\n".join(done)]
    text = "\n".join(["x | y | z"] * 2000 + ["", "plain words here"] + ["more words here"] * 2000)
    blocks = one(spark, lambda c: K._page_blocks(c)["blocks"], text)[0]
    assert [(b.kind, b.text.count("\n") + 1) for b in blocks] == [("table", 2000), ("paragraph", 2001)]


@pytest.mark.parametrize("line, level", [
    ("PART II", 1), ("Item 1A. Risk Factors", 2), ("SECTION 4", 2), ("Schedule III", 2), ("Exhibit 21", 2), ("RISK FACTORS", 2),
    ("Note 12 Leases", 3), ("2.1 Revenue", 3), ("Plain text line", 0), ("", 0), ("X" * 81, 0), ("ITEM 7. " + "a" * 90, 2), ("ITEM 7. " + "a" * 120, 0)])
def test_heading_levels(spark, line, level):
    assert one(spark, lambda c: K.heading_score(F.col(c)), line)[0].level == level


def test_table_rows(spark):
    lines = ["| a | b |", "10 20 30", "a,b,c,d", "name   value   other", "one | pipe", "text only", ""]
    assert one(spark, lambda c: K.is_table_row(F.col(c)), *lines) == [True, True, True, True, False, False, False]


# --- chunking against a direct walk ---------------------------------------------------

def tok(t):
    return max(1, len(t) // 4)


def direct_blocks(blocks):
    """Chunks of a list of (kind, level, text, page) by the plain rules, one list per pass."""
    import re
    section = sub = ""
    rows = []
    for kind, level, text, page in blocks:
        if kind == "heading" and level <= 2:
            section, sub = text, ""
        elif kind == "heading":
            sub = text
        rows.append((kind, level, text, page, section, sub))
    chunks, parts, pages, n, sec, ss, head, tab = [], [], set(), 0, "", "", False, False

    def emit(overlap):
        nonlocal parts, pages, n, head, tab
        if not parts:
            return
        text = "\n\n".join(parts)
        chunks.append([sec, ss, min(pages, default=None), max(pages, default=None), text, tok(text), head, tab])
        last = parts[-1]
        parts, pages, n, head, tab = [], set(), 0, False, False
        if overlap and tok(last) <= 150:
            parts, n = [last], tok(last)

    for kind, level, text, page, s, b in rows:
        size = tok(text)
        if kind == "heading":
            if level <= 2:
                emit(False)
            elif n >= 300:
                emit(True)
            sec, ss, head = s, b, True
            parts.append(text)
            pages.add(page)
            n += size
        elif kind == "table":
            if n >= 300:
                emit(True)
            parts.append(text)
            pages.add(page)
            n, tab = n + size, True
            if n >= 800:
                emit(False)
        else:
            if n + size > 1200 and n >= 300:
                emit(True)
            parts.append(text)
            pages.add(page)
            n += size
            sec, ss = s or sec, b or ss
            if n >= 800:
                emit(True)
    emit(False)
    cut = []
    for c in chunks:
        if c[5] <= 1200:
            cut.append(c)
            continue
        held, m = [], 0
        for piece in re.split(r"(?<=[.!?])\s+", c[4]):
            if held and m + tok(piece) > 1200:
                t = " ".join(held)
                cut.append([*c[:4], t, tok(t), *c[6:]])
                held, m = [], 0
            held.append(piece)
            m += tok(piece)
        t = " ".join(held)
        cut.append([*c[:4], t, tok(t), *c[6:]])
    if len(cut) <= 1:
        return cut
    out, i = [], 0
    while i < len(cut):
        c = list(cut[i])
        while c[5] < 300 and i + 1 < len(cut):
            d = cut[i + 1]
            c[4] = c[4] + "\n\n" + d[4]
            c[5] = tok(c[4])
            c[3] = d[3] or c[3]
            c[6], c[7] = c[6] or d[6], c[7] or d[7]
            c[0], c[1] = c[0] or d[0], d[1] or c[1]
            i += 1
        out.append(c)
        i += 1
    return [c for c in out if c[5] >= 30 or len(c[4].strip()) >= 100]


def random_document(r, doc):
    """Pages whose blocks are known: every block is closed by a blank line."""
    pages, blocks = [], []
    for p in range(1, r.randrange(2, 9)):
        lines = []
        for _ in range(r.randrange(1, 12)):
            kind = r.random()
            if kind < 0.12:
                text, row = f"ITEM {r.randrange(9)}. Heading", ("heading", 2)
            elif kind < 0.2:
                text, row = f"Note {r.randrange(9)} Detail", ("heading", 3)
            elif kind < 0.35:
                text, row = "\n".join(f"| r{i} | {i} | {i * 7} |" for i in range(r.choice([2, 5, 160]))), ("table", 0)
            else:
                n = r.choice([3, 30, 120, 400, 1500])
                text = ". ".join("word " * r.randrange(5, 30) + "end" for _ in range(n // 15 + 1)).strip() + "."
                row = ("paragraph", 0)
            lines += [text, ""]
            blocks.append((*row, text, p))
        pages.append((doc, p, "\n".join(lines)))
    return pages, blocks


def test_chunks_equal_a_direct_walk(spark):
    r = random.Random(3)
    made = {f"doc{i}": random_document(r, f"doc{i}") for i in range(40)}
    made["tiny"] = ([("tiny", 1, "Just a line.")], [("paragraph", 0, "Just a line.", 1)])
    pages = spark.createDataFrame([p for ps, _ in made.values() for p in ps], "document_id string, page int, clean_text string")
    want = {f"{d}_chunk_{i:03d}": tuple(c) for d, (_, blocks) in made.items() for i, c in enumerate(direct_blocks(blocks), 1)}
    for limit in (10000, 3, 0):
        got = {r.chunk_id: (r.section, r.subsection, r.page_start, r.page_end, r.text, r.token_count, r.has_heading, r.contains_table)
               for r in K.chunk_document(pages, whole_document_pages=limit).collect()}
        assert got == want, limit
    K.register(spark)
    K.page_blocks(pages).createOrReplaceTempView("page_blocks_test")
    rows = spark.sql("SELECT * FROM chunk_text(TABLE(page_blocks_test))").collect()
    assert {f"{r.document_id}_chunk_{r.chunk_no:03d}": r.text for r in rows} == {k: v[4] for k, v in want.items()}


def test_blocks_run_over_pages(spark):
    rows = [("d", 1, "Intro text\nmore"), ("d", 2, "goes on\n\nPART I"), ("d", 3, "| a | b |\n| c | d |"), ("d", 4, "| e | f |\nText"), ("d", 5, ""), ("d", 6, "Text")]
    pages = spark.createDataFrame(rows, "document_id string, page int, clean_text string")
    got = [(r.block_type, r.text, r.pages) for r in K.parse_blocks(pages).orderBy("block_no").collect()]
    assert got == [("paragraph", "Intro text\nmore\ngoes on", [1, 2]), ("heading", "PART I", [2]), ("table", "| a | b |\n| c | d |\n| e | f |", [3, 4]),
                   ("paragraph", "Text", [4]), ("paragraph", "Text", [6])]


ODD_LINES = ["", "$ 1 2 3", "₹ 5,000.25 € 7", "1,2,,3..4.5", "a\t\t\tb   c   d", "   x   y   ", "٣٤ ५६ . 7", "x  y    z     w", "€€ ,", "12.  .5"]


def test_cheaper_patterns_count_the_same(spark):
    d = spark.createDataFrame([(x,) for x in ODD_LINES], "t string")
    pairs = [(C.NUMBER_GROUP, r"(?U)[$₹]?\s*[\d,]+\.?\d*"), (K.NUMBER_GROUP, r"(?U)[$₹€¥]?\s*[\d,]+\.?\d*"), (K.WIDE_GAP, r"(?U)\S+\s{3,}")]
    for row in d.select("t", *[F.array(F.regexp_count("t", F.lit(a)), F.regexp_count("t", F.lit(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).collect():
        assert all(a == b for a, b in row[1:]), row


def test_time_of_a_line_does_not_grow_with_the_square_of_a_word(spark):
    d = spark.range(1).select(F.concat(F.repeat(F.lit("ab"), 100_000), F.lit("   c   d")).alias("t"))
    started = time.monotonic()
    assert d.select(K.is_table_row(F.col("t"))).first()[0]
    assert time.monotonic() - started < 20


def test_composed_texts_skip_python(spark):
    texts = ["plain", "Müller – 漢字かな 한글 €", "é", "が", "각ᆨ", "Å", "x\U0001d15e", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(F.col("t").rlike(C.COMPOSED)).collect()] == [True, True, False, False, False, False, False, None]
    assert [r[0] for r in d.select(C.normalize_unicode("t")).collect()] == [t and unicodedata.normalize("NFC", t) for t in texts]


def test_lines_join_over_group_counts_and_pages_without_continuations(spark):
    texts = ["A first line of words here\ngoes on 1 and 2\nand ends 3 here\nnot joined any more", "One\nTwo\n", "", None,
             "Costs of 1, 2 and 3 were met then\nso this stays", "Costs of one were met then\nso this joins-\nand this"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(C.fix_broken_lines("t")).collect()] == [
        "A first line of words here goes on 1 and 2 and ends 3 here\nnot joined any more", "One\nTwo\n", "", None,
        "Costs of 1, 2 and 3 were met then\nso this stays", "Costs of one were met then so this joinsand this"]


def test_summary_from_headings_equals_that_from_blocks(spark):
    text = "ITEM 1. Business\nsome words here\n\nNotes 3 on it\nPART II\nmore words\n| a | b |"
    rows = [("d1", 1, text), ("d1", 2, "tail | of | it\nITEM 1. Business\nPART III\nend"), ("d2", 1, "no heading"), ("d3", 1, "")]
    pages = spark.createDataFrame(rows, "document_id string, page int, clean_text string")
    chunks, paged = K.chunk_document(pages), K.page_blocks(pages)
    old, new = (sorted(map(tuple, K.chunk_summary(chunks, b).collect())) for b in (K.parse_blocks(pages), K.headings(paged)))
    assert old == new and [r[-1] for r in new] == [["ITEM 1. Business", "PART II", "PART III"], None]
    for most in (0, 2000):
        assert sorted(map(tuple, K.chunk_paged(paged, pages, most).collect())) == sorted(map(tuple, chunks.collect()))
