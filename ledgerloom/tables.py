"""Readers for the table folder a job is pointed at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
         "events", "documents", "embeddings", "pages", "benchmark", "labels",
         "conversations")


# Tables whose rows hold long texts, so that the work per row is large.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder.

    A text table stored in fewer splits than there are cores is spread over the cores
    first, because one task would do all the text work.  A large table has many splits
    and is read as it is, without a shuffle.
    """
    if name not in NAMES:
        raise ValueError(f"unknown table {name}")
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    if name in TEXT_TABLES and not df.isStreaming:
        cores = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
    return df
