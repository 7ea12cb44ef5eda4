"""Phrase collocations by marginalising one count of the longest windows.

Every word of a text starts one window: itself and the next words of its piece, as lead columns
w1, w2, .. wN, padded with '' where the piece ends.  Only these longest windows are counted.  A Spark
ROLLUP over (w1, .. wN) then sums them to all shorter prefixes: the count of a phrase is the sum of the
windows that begin with it, so no n-gram table of its own is ever exploded, and the total of a language
is the sum of all its windows.

Most windows of a corpus are rare and cannot hold a candidate.  So passes before the count hash the windows of
1 and 2, then of 3 words and so on, count the hashes (capped at min_count) in ranges of the hash, and keep one
bit for each hash that is frequent: a bitmap of 2^filter_bits bits whatever the corpus.  A window of more
words is hashed only where both windows of one word less inside it have their bits.  In the count a window is
padded from the first word on whose prefix has no bit.  A hash counts no less than each of its
phrases, so no phrase of min_count or more is lost and all counts that are used are exact; where the
bitmap fills up, more windows are counted than needed.

Memory: a task holds chunk bytes of text (a longer piece whole) with its words as numbers; a range of
hashes holds hashes of about range_bytes of text; the driver and each Python worker hold the bitmap.  A frequent word or
phrase is one row of each chunk that has it, summed before the shuffle.

Defined results: a null text has no words, a null lang is `und`; a text without words, or an empty table,
gives no rows; repeated rows count each time; a very long text is counted in parts cut between pieces;
ties in score and count are ordered by the phrase's UTF-8 bytes; other columns than lang and text are not
looked at.  Products are exact as long as 1000000 * a * a has at most 38 digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize, shuffles_cleaned

CHUNK = 1 << 23
RANGE = 1 << 22
FILTER_BITS = 28
BATCH = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0: of a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


def _parts(texts: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Languages and texts in UTF-8, about chunk bytes at a time; a longer text is cut after a piece."""
    langs, held, size = [], [], 0
    for batch in texts:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
            while len(data):
                end = len(data)
                if end > chunk:
                    cut = np.flatnonzero(_KIND[data[:chunk]] == 2)
                    if not len(cut):
                        cut = np.flatnonzero(_KIND[data] == 2)
                    end = cut[-1] + 1 if len(cut) and cut[-1] < chunk else cut[0] + 1 if len(cut) else end
                if held and size + end > chunk:
                    yield langs, held
                    langs, held, size = [], [], 0
                langs.append(lang)
                held.append(data[:end])
                size += end + 1
                data = data[end:]
    if held:
        yield langs, held


class Words:
    """Words of some texts: numbers into a list of different words, and whether another word of their piece follows."""

    def __init__(self, langs: list[str], texts: list[np.ndarray]):
        data = _LOWER[np.concatenate([x for text in texts for x in (text, np.array([10], np.uint8))])]
        kind = _KIND[data]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        first, last = edge[::2], edge[1::2]
        offsets = np.zeros(len(first) + 1, np.int32)
        np.cumsum(last - first, out=offsets[1:])
        kept = data[inside]
        found = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(kept)).dictionary_encode()
        self.id, self.word = found.indices.to_numpy().astype(np.int64), found.dictionary
        piece = np.searchsorted(np.flatnonzero(kind == 2), first)
        self.followed = np.append(piece[1:] == piece[:-1], False)[:len(first)]
        self.lang_name, of_text = np.unique(np.array(langs, object), return_inverse=True)
        begins = np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
        self.lang = of_text[np.searchsorted(begins, first, "right") - 1]

    def windows(self, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 word, 2 words and so on: the places where so many stand in the piece, and their hash; equal in every task."""
        word = pd.util.hash_array(self.word.to_numpy(zero_copy_only=False), categorize=False)
        lang = pd.util.hash_array(self.lang_name, categorize=False)
        at, x = np.arange(len(self.id)), _mixed(word[self.id], lang[self.lang])
        yield at, x
        for m in range(1, words):
            on = self.followed[at + m - 1]
            at, x = at[on], x[on]
            x = _mixed(x, word[self.id[at + m]])
            yield at, x


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += y
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Bitmap:
    """Which windows may be frequent."""

    def __init__(self, packed: bytes, size: int):
        self.size = np.uint64(64 - size)
        self.bits = np.frombuffer(zlib.decompress(packed), np.uint8)

    def has(self, value: np.ndarray) -> np.ndarray:
        at = (value >> self.size).astype(np.int64)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def depth(self, w: Words, words: int) -> np.ndarray:
        """For each place, how many words its longest prefix with a bit has."""
        depth = np.zeros(len(w.id), np.int8)
        for m, (at, value) in enumerate(w.windows(words), 1):
            near = at[(depth[at] == m - 1) & ((m < 3) | (depth[np.minimum(at + 1, len(depth) - 1)] >= m - 1))]
            depth[near[self.has(value[np.searchsorted(at, near)])]] = m
        return depth


def frequent_windows(texts: DataFrame, words: int, min_count: int, filter_bits: int, chunk: int, range_bytes: int) -> bytes:
    """One bit, packed and compressed, for each value of the first filter_bits bits of a window's hash: set if a hash there may count min_count."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((size // range_bytes).bit_length(), 3), filter_bits - 3, 20)
    held = np.uint8 if min_count < 256 else np.int64
    whole = np.zeros((1 << bits, (1 << (filter_bits - bits)) // 8), np.uint8)
    shared = None

    def count(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
        known = None
        for langs, parts in _parts(batches, chunk):
            known = known or (Bitmap(shared.value, filter_bits) if shared else None)
            w = Words(langs, parts)
            depth = known.depth(w, sizes[0] - 1) if known else None
            found = []
            for m, (at, value) in enumerate(w.windows(sizes[-1]), 1):
                if m in sizes:
                    found.append(value if depth is None else value[(depth[at] == m - 1) & (depth[at + 1] == m - 1)])
            # The bits that name the range, and 32 more.
            value, n = np.unique(np.concatenate(found) >> np.uint64(32 - bits), return_counts=True)
            n = np.minimum(n, min_count).astype(held)
            at = np.append(np.searchsorted(value, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32)), len(value))
            value = value.astype(np.uint32)
            some = np.flatnonzero(np.diff(at))
            slices = [slice(at[i], at[i + 1]) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([value[s].tobytes() for s in slices], pa.binary()),
                                              pa.array([n[s].tobytes() for s in slices], pa.binary())], ["range", "value", "n"])

    def decide(table: pa.Table) -> pa.Table:
        value = np.frombuffer(b"".join(table.column("value").to_pylist()), np.uint32)
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), held).astype(np.int64)
        order = np.argsort(value)
        value = value[order]
        start = np.flatnonzero(np.diff(value, prepend=~value[:1]))
        often = value[start][np.add.reduceat(n[order], start) >= min_count]
        own = np.zeros(1 << (filter_bits - bits), bool)
        own[often >> np.uint32(32 - (filter_bits - bits))] = True
        return pa.table({"range": table.column("range")[:1], "bits": pa.array([zlib.compress(np.packbits(own).tobytes(), 1)], pa.binary())})

    for sizes in [(1, 2), *((m,) for m in range(3, words + 1))]:
        with shuffles_cleaned(texts.sparkSession):
            counted = texts.mapInArrow(lambda batches, sizes=sizes: count(batches, sizes), "range long, value binary, n binary")
            for row in counted.groupBy("range").applyInArrow(decide, "range long, bits binary").collect():
                whole[row["range"]] |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        shared = texts.sparkSession.sparkContext.broadcast(zlib.compress(whole.tobytes(), 1))
    return shared.value


def longest_windows(texts: DataFrame, words: int, min_count: int, filter_bits: int = FILTER_BITS, chunk: int = CHUNK, range_bytes: int = RANGE) -> DataFrame:
    """lang, w1 .. wN, c: padded windows of N words with their counts, already summed for a chunk of text."""
    names = [f"w{i + 1}" for i in range(words)]
    shared = texts.sparkSession.sparkContext.broadcast(frequent_windows(texts, words, min_count, filter_bits, chunk, range_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for langs, parts in _parts(batches, chunk):
            known = known or Bitmap(shared.value, filter_bits)
            w = Words(langs, parts)
            if not len(w.id):
                continue
            depth, pad = known.depth(w, words), len(w.word)
            key, where = w.lang.astype(np.int64), None
            for m in range(words):
                lead = np.full(len(w.id), pad, np.int64)
                real = np.flatnonzero(depth > m)
                lead[real] = w.id[real + m]
                _, where, key, n = np.unique(key * (pad + 1) + lead, return_index=True, return_inverse=True, return_counts=True)
            spelled = pa.concat_arrays([w.word, pa.array([""])])
            for i in range(0, len(where), BATCH):
                part = where[i:i + BATCH]
                columns = [spelled.take(pa.array(np.where(depth[part] > m, w.id[np.minimum(part + m, len(w.id) - 1)], pad))) for m in range(words)]
                yield pa.RecordBatch.from_arrays([pa.array(w.lang_name[w.lang[part]], pa.string()), *columns, pa.array(n[i:i + BATCH], pa.int64())], ["lang", *names, "c"])

    return texts.mapInArrow(count, "lang string, " + "".join(f"{c} string, " for c in names) + "c long")


def phrase_counts(docs: DataFrame, words: int = 3, min_count: int = 10, **sizes: int) -> DataFrame:
    """lang, n_words, phrase, f: all words together (n_words 0), and phrases of 1 to `words` words (2 at least) counted min_count times or more; sizes as of longest_windows."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    names = [f"w{i + 1}" for i in range(words)]
    summed = longest_windows(texts, words, min_count, **sizes).groupBy("lang", *names).agg(F.sum("c").alias("c"))
    joined = ", ".join(names)
    rolled = docs.sparkSession.sql(f"SELECT lang, {joined}, sum(c) AS f, {words} - bit_count(grouping_id()) AS n_words FROM {{w}} GROUP BY lang, ROLLUP({joined})", w=summed)
    real = F.coalesce(F.element_at(F.array(*names), F.greatest("n_words", F.lit(1))), F.lit("x")) != ""
    return rolled.filter(real & ((F.col("n_words") == 0) | (F.col("f") >= min_count))).select("lang", F.col("n_words").cast("int").alias("n_words"), F.concat_ws(" ", *names).alias("phrase"), "f")


def collocations(docs: DataFrame, words: int = 3, min_count: int = 10, share: int = 50, top: int | None = 2000, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of 2 to `words` words of each language.

    The score is that of the phrase's weakest cut.  A phrase of which a longer candidate that holds
    it makes up share per cent or more is left out.
    """
    counts = materialize(phrase_counts(docs, words, min_count, **sizes), "phrases")
    said = F.split("phrase", " ")
    candidates = counts.filter("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), said.alias("said"))
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", F.array_join(F.expr("slice(said, 1, cut)"), " ").alias("left"),
                     F.array_join(F.expr("slice(said, cut + 1, n_words - cut)"), " ").alias("right"))
    part = counts.filter("n_words > 0")
    cut = cut.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    scored = cut.withColumn("score", F.expr("(1000000 * cast(a AS decimal(19,0)) * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    place = F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1))
    inner = candidates.filter("n_words > 2").select("*", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size")).select("lang", "a", "said", "size", place.alias("place"))
    held = inner.groupBy("lang", F.array_join(F.expr("slice(said, place, size)"), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    whole = counts.filter("n_words = 0").select("lang", F.col("f").alias("n"))
    left = weakest.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).join(whole, "lang")
    ranked = left.selectExpr("lang", "phrase", "a", "m.l AS l", "m.r AS r", "n", "m.score AS score",
                             "cast(row_number() OVER (PARTITION BY lang ORDER BY m.score DESC, a DESC, phrase) AS long) AS rank")
    return (ranked if top is None else ranked.filter(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
