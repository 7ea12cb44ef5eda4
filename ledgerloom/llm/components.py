"""Connected components of a link table, without any component in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize, release


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """u, root for every node of the links (u, v): root is the smallest node reachable.

    Alternates two steps until the links no longer change.  Large star: a node's larger neighbours
    are linked to its smallest one; small star: so are its smaller neighbours.  Both keep what is
    connected; the links shrink to stars around the smallest nodes in about log(nodes) rounds.  Each
    round is written to the shared folder; only a count and a checksum of it reach the driver.
    """
    links = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    before = _state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(star.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(links)
        links, after = new, _state(new)
        if after == before:
            break
        before = after
    return links.select("u", F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
