"""A corpus pipeline: quality, near-duplicates, decontamination, personal data, packing.

Every stage but the last returns the rows it keeps with all columns of its input, whatever their names; an
empty table gives an empty one; a long text is worked on whole; rows that repeat are judged alike.  A null text
counts as an empty one and stays null where it is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, packing, pii, quality, similar
from ledgerloom.llm.catalog import table, tokenizer_path
from ledgerloom.llm.names import fresh
from ledgerloom.session import materialize, release


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more; a null or empty text has a score like any other."""
    score = fresh(docs, "_score")
    return quality.scored(docs, table(spark, sf_dir, "labels"), out=score).filter(F.col(score) >= 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; of rows equal in id and text, one.

    Near-duplicates share 0.8 or more of their five-word shingles, directly or over others.
    Null, empty and blank texts are near-duplicates of each other only.  A digest of id and text stands for a row, so null and repeated ids lose nothing, and the texts
    are shuffled once, by that digest.
    """
    key, kept = fresh(docs, "_row_key"), fresh(docs, "_kept_key")
    keyed = docs.withColumn(key, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))))
    found = similar.near_duplicates(keyed, key)
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key).alias("key")))
    chosen = found.groupBy("root").agg(least.alias("least")).select(F.col("least.key").alias(kept))
    return keyed.join(chosen, F.col(key) == F.col(kept), "left_semi").dropDuplicates([key]).drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark phrase occurs; those without words stay."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    bad = found.select(F.col("doc_id").alias(bad_id := fresh(docs, "_bad_id")), F.col("text_key").alias(bad_key := fresh(docs, "_bad_key")))
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (decontam.text_key(F.col("text")) == F.col(bad_key))
    return docs.join(bad, same, "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind, in every row; n_chars follows the text where it changes."""
    spans = fresh(docs, "_spans")
    found = pii.find_spans(docs, out=spans)
    masked = found.withColumn("text", pii.masked(F.col("text"), F.col(spans)))
    return masked.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars"))).drop(spans)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 2048 ids; a null or empty text is its closing id."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("personal_data", mask_personal_data), ("packing", pack)]
# Scores, hashes and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = materialize(stage(spark, docs, sf_dir), name)
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
