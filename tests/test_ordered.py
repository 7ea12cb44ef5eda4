from __future__ import annotations

import random

from pyspark.sql import Window, functions as F

from ledgerloom.operators import ordered as O


def hot_rows(spark, n=3000):
    """Half of the rows share one key and many share one value."""
    r = random.Random(7)
    rows = [("hot" if r.random() < 0.5 else f"k{r.randrange(40)}", r.choice([0.0, 0.0, r.random()]), i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, v double, pos int")


def test_rank_within_equals_window(spark):
    df = hot_rows(spark)
    order = [F.desc("v"), F.col("pos")]
    want = {(r.k, r.pos): r.n for r in df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order))).collect()}
    got = {(r.k, r.pos): r["rank"] for r in O.rank_within(df, ["k"], order, partitions=7).collect()}
    assert got == want


def test_rank_within_splits_a_hot_key(spark):
    placed = hot_rows(spark).repartitionByRange(7, "k", F.desc("v"), "pos").withColumn("p", F.spark_partition_id())
    assert placed.where("k = 'hot'").select("p").distinct().count() > 1


def test_scan_within_equals_window(spark):
    df = hot_rows(spark).withColumn("piece", F.expr("pos div 100")).withColumn("x", F.expr("pos % 5"))
    marked = F.when(F.col("x") == 0, F.col("pos"))
    for inclusive, end in ((True, Window.currentRow), (False, -1)):
        w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, end)
        want = {(r.k, r.pos): (r.s, r.l) for r in df.select("k", "pos", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("s"),
                                                           F.last(marked, True).over(w).alias("l")).collect()}
        out = O.scan_within(df, ["k"], ["pos"], "piece", sums={"s": F.col("x")}, lasts={"l": marked}, inclusive=inclusive)
        assert {(r.k, r.pos): (r.s, r.l) for r in out.collect()} == want


def test_first_last_top(spark):
    df = hot_rows(spark)
    first = {r.k: r.pos for r in O.first_per_key(df, ["k"], [F.col("v"), F.col("pos")]).collect()}
    last = {r.k: r.pos for r in O.last_per_key(df, ["k"], [F.col("v"), F.col("pos")]).collect()}
    rows = df.collect()
    for k in first:
        mine = [(r.v, r.pos) for r in rows if r.k == k]
        assert (first[k], last[k]) == (min(mine)[1], max(mine)[1])
    top = O.top_per_key(df, ["k"], [F.desc("v"), F.col("pos")], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.where("k = 'hot'").count() == 3
