"""Registrable domains by a table of public suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.urls import host


def registrable_domains(urls: DataFrame, url: str, rules: DataFrame, rule: str = "rule", out: str = "domain") -> DataFrame:
    """Adds the public suffix of each URL's host and one label before it; null where the host is a suffix itself or empty.

    A rule is a suffix (``co.uk``), one with any label before it (``*.ck``) or an exception to such (``!www.ck``); of the rules that
    fit a host an exception counts, else the longest; without any, the last label is the suffix.  Each different host
    meets the table once, by an equality join of its tails with the rules, so the table may have any size.
    """
    name = F.regexp_replace(host(url), r"\.$", "")
    hosts = urls.select(name.alias("_host")).where(F.col("_host") != "").distinct()
    labels = hosts.withColumn("_labels", F.split("_host", r"\."))
    tails = labels.select("_host", "_labels", F.explode(F.sequence(F.lit(1), F.size("_labels"))).alias("_n"))
    tail = F.array_join(F.slice("_labels", F.size("_labels") - F.col("_n") + 1, F.col("_n")), ".")
    parent = F.array_join(F.slice("_labels", F.size("_labels") - F.col("_n") + 2, F.col("_n")), ".")
    keys = F.array(F.struct(F.lit(0).alias("exception"), tail.alias("key")), F.struct(F.lit(0).alias("exception"), F.concat(F.lit("*."), parent).alias("key")),
                   F.struct(F.lit(1).alias("exception"), F.concat(F.lit("!"), tail).alias("key")))
    asked = tails.select("_host", "_n", F.explode(keys).alias("_k")).select("_host", "_n", "_k.*")
    known = rules.select(F.lower(rule).alias("key")).distinct()
    # An exception is a suffix without its first label.
    found = asked.join(known, "key").groupBy("_host").agg(F.max(F.struct("exception", (F.col("_n") - F.col("exception")).alias("size"))).alias("_m"))
    size = F.coalesce(F.col("_m.size"), F.lit(1))
    domain = F.when(F.size("_labels") > size, F.array_join(F.slice("_labels", F.size("_labels") - size, size + 1), "."))
    named = labels.join(found, "_host", "left").select("_host", domain.alias(out))
    return urls.withColumn("_host", name).join(named, "_host", "left").drop("_host")
