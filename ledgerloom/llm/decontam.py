"""Benchmark decontamination by a distributed positional inverted index.

Every run of WINDOW words of a benchmark item is a phrase.  Corpus frequencies of all words are
counted first; a phrase is then searched through the posting list of its rarest word only, shifted
by the place the word has in the phrase, and the words around the posting are compared with it.
A phrase with a word that the corpus lacks cannot occur and is left out.

A posting is a row (document, position, word) made by the scan and met at once with the phrases, in
blocks of about PHRASE_BLOCK: a block is a phrase text, four numbers and a digest per row, so its
size is bounded, and it is what gets broadcast.  More phrases make more blocks, each with a scan of
its own.  What is shuffled are word counts and the hits, never texts.

`exact` hits are occurrences of a whole phrase.  `near` hits are postings of the rarest word with all
but `slop` of the phrase's different words within WINDOW - 1 words on either side, in any order.

Defined results: null and empty texts have no words and no hits; an item without words is not
searched; rows of documents that are equal in id and text get equal results, rows with the same id
and other texts are told apart by a hash of the text; an empty benchmark or corpus gives zero counts
or no rows; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize

WINDOW = 10
PHRASE_BLOCK = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = " "  # no word has a space: the entry behind a document's last word


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only; the fast function gives the same where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words in order; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def text_key(text: Column) -> Column:
    """Tells apart documents with the same id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, terms of every phrase of the items."""
    words = items.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    n = F.size("words")
    cut = F.when(n < window, F.array(F.col("words"))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))), lambda i: F.slice("words", i, window)))
    return words.select("item_id", F.explode(cut).alias("terms")).distinct()


def rarest_terms(items: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, phrase, n_terms, term, place: the rarest word of each phrase that the corpus can hold."""
    parts = phrases(items, window).withColumn("phrase", F.array_join("terms", " "))
    terms = parts.select("item_id", "phrase", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("place", "term"))
    counts = (docs.select(F.explode(words_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
              .join(terms.select("term").distinct(), "term"))
    known = terms.join(counts, "term", "left")
    best = known.groupBy("item_id", "phrase", "n_terms").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "place")).alias("best"))
    return best.filter("best.n > 0").select("item_id", "phrase", "n_terms", "best.term", "best.place")


def hits(docs: DataFrame, rare: DataFrame, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """Matches and document ends: doc_id, text_key, item_id, start, n_terms, exact, near; item_id is null at an end, start its words."""
    stored = materialize(rare, "phrases")
    blocks = -(-stored.count() // PHRASE_BLOCK) or 1
    words = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), words_of(F.col("text")).alias("words"))
    entries = words.select("doc_id", "text_key", "words", F.posexplode(F.concat("words", F.array(F.lit(END)))).alias("at", "term"))
    end = docs.sparkSession.range(1).select(
        F.lit(None).cast("long").alias("item_id"), F.lit(END).alias("phrase"), F.lit(0).alias("n_terms"), F.lit(END).alias("term"), F.lit(0).alias("place"))
    found = None
    for b in range(blocks):
        part = stored.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b) if blocks > 1 else stored
        part = (part.unionByName(end) if b == 0 else part).withColumn("wanted", F.array_distinct(F.split("phrase", " ")))
        start = F.col("at") - F.col("place")
        here = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("n_terms")), " ")
        first = F.greatest(F.col("at") - (window - 1), F.lit(0))
        around = F.slice("words", first + 1, F.col("at") - first + window)
        exact = (start >= 0) & (here == F.col("phrase"))
        near = (F.col("n_terms") > slop + 1) & (F.size(F.array_except("wanted", around)) <= slop)
        is_end = F.col("item_id").isNull() & (F.col("term") == END)
        met = (entries.join(F.broadcast(part), "term")
               .select("doc_id", "text_key", "item_id", start.alias("start"), "n_terms",
                       F.when(is_end, False).otherwise(exact).alias("exact"), F.when(is_end, False).otherwise(near).alias("near"), is_end.alias("is_end"))
               .filter("is_end or exact or near"))
        found = met if found is None else found.unionByName(met)
    return found


def covered(starts: Column) -> Column:
    """Words inside any of the sorted (start, n) runs."""
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))

    def step(acc, s):
        end = s["start"] + s["n_terms"]
        return F.struct(F.greatest(acc["reach"], end).alias("reach"),
                        (acc["n"] + F.greatest(end - F.greatest(s["start"], acc["reach"]), F.lit(0))).alias("n"))

    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 2) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted as strings), n_near_items, contaminated."""
    found = hits(docs, rarest_terms(items, docs, window), window, slop)
    per = found.groupBy("doc_id", "text_key").agg(
        F.max(F.when(F.col("is_end"), F.col("start"))).cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.struct("start", "n_terms")))).alias("_runs"),
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id").cast("string")))).alias("items"),
        F.count_distinct(F.when(F.col("near"), F.col("item_id"))).alias("n_near_items"))
    per = per.withColumn("n_hit", covered(F.col("_runs")).cast("long")).drop("_runs")
    keys = docs.select("doc_id", text_key(F.col("text")).alias("text_key"))
    same = F.col("k.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("k.text_key") == F.col("p.text_key"))
    return (keys.alias("k").join(per.alias("p"), same)
            .select("k.doc_id", "p.n_words", "p.n_hit", F.size("p.items").cast("long").alias("n_items"), "p.items", "p.n_near_items",
                    (F.col("p.n_hit") > 0).alias("contaminated"), "k.text_key"))
