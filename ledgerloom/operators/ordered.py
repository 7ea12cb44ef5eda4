"""Ordered computations that hold when one key owns a large share of the rows.

A window over a hot key is one task.  The helpers here either keep the work
inside aggregates (which combine before the shuffle) or split the key into
pieces, solve the pieces in parallel and add a small carry per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import materialize


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by aggregation: partial results meet in the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]).alias("_at"),
                       F.struct(*rest).alias("_row"))
    return (packed.groupBy(*keys).agg(F.min_by("_row", "_at").alias("_row"))
            .select(*keys, "_row.*"))


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]).alias("_at"),
                       F.struct(*rest).alias("_row"))
    return (packed.groupBy(*keys).agg(F.max_by("_row", "_at").alias("_row"))
            .select(*keys, "_row.*"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int | None,
                out: str = "rn") -> DataFrame:
    """First ``k`` rows of each key, or all of them, numbered, if ``k`` is None.

    The filter on row_number lets Spark cut each input partition to ``k`` rows
    per key before the shuffle, so a hot key never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col(out) <= k)


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """row_number() of every row inside its key, without one task per key.

    Rows are range-partitioned on (keys, order), so a hot key is spread over many
    partitions.  A row's number is its number inside (partition, key) plus the
    rows of the same key in earlier partitions.  Only the first key of a partition
    can have such rows, so the carry table has fewer rows than there are
    partitions and may be broadcast.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id()), "rank")
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = (sizes.withColumn("_before", F.sum("_n").over(before))
             .where(F.col("_before") > 0).drop("_n"))
    local = Window.partitionBy("_part", *keys).orderBy(*order)
    numbered = placed.withColumn("_local", F.row_number().over(local).cast("long"))
    same = numbered["_part"] == carry["_part"]
    for k in keys:
        same = same & numbered[k].eqNullSafe(carry[k])
    return (numbered.join(F.broadcast(carry), same, "left")
            .select(*[numbered[c] for c in df.columns],
                    (numbered["_local"] + F.coalesce(carry["_before"], F.lit(0))).alias(out)))


def scan_within(df: DataFrame, keys: list[str], order: list[str], piece: str,
                sums: dict[str, Column] | None = None,
                lasts: dict[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """Running sums and last-non-null values along ``order`` inside each key.

    ``piece`` names a column that cuts a key into consecutive bounded stretches (for
    instance ``page div 256``); it must rise with ``order``.  Each stretch is scanned
    on its own; stretches exchange one summary row.  Both windows and the final join
    use (keys, piece).  The input is read twice, so hand in narrow rows of a written
    table and join the result back.  With ``inclusive=False`` the current row is left out.
    """
    sums, lasts = sums or {}, lasts or {}
    end = Window.currentRow if inclusive else -1
    here = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    back = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    d = df.select("*", *[c.alias(f"_v_{n}") for n, c in {**sums, **lasts}.items()])
    summary = d.groupBy(*keys, piece).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_t_{n}") for n in lasts])
    carry = summary.select(
        *keys, piece,
        *[F.sum(f"_t_{n}").over(back).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(back).alias(f"_c_{n}") for n in lasts])
    local = d.select(
        *df.columns,
        *[F.sum(f"_v_{n}").over(here).alias(f"_l_{n}") for n in sums],
        *[F.last(f"_v_{n}", ignorenulls=True).over(here).alias(f"_l_{n}") for n in lasts])
    joined = local.join(carry, [*keys, piece], "left")
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in lasts])
