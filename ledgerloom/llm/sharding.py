"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in the order of (doc_id, size, checksum).  A Feistel network over the
smallest power of two not below N permutes the numbers; results outside 0..N-1 are permuted again
until they fall inside (cycle walking), which gives a permutation of 0..N-1 itself.  A row's place p
gives shard p mod S and slot p div S, so shard sizes differ by one row at most, slots have no gaps,
and both can be computed from the row number alone (`place_of`), and back (`number_at`).

Only DataFrame functions are used.  Texts are read once for size and checksum; what is shuffled and
written are the four narrow columns.

Defined results: a null text has no bytes (size 1, checksum 0); null ids sort first; rows equal in
id, size and checksum are interchangeable and get places of their own; an empty table gives no rows;
further columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import materialize

ROUNDS = 8
PRIME = 2147483647
MULTIPLIER = 1181783497
WALK = 32


def round_keys(seed: int) -> list[int]:
    """One key per round, from the seed by a linear congruence."""
    keys, x = [], seed % PRIME
    for _ in range(ROUNDS):
        x = (x * 48271 + 11) % PRIME
        keys.append(x)
    return keys


def halves(n: int) -> tuple[int, int]:
    """Bits of the left and of the right half for n rows."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    return bits // 2, bits - bits // 2


def _mix(value: Column, key: Column) -> Column:
    spread = ((value + key) % F.lit(PRIME)) * F.lit(MULTIPLIER)
    return spread.bitwiseXOR(F.shiftright(spread, 29)) % F.lit(PRIME)


def feistel(x: Column, n: int, seed: int, backwards: bool = False) -> Column:
    """One pass of the network over numbers of the power of two that covers n."""
    left, right = halves(n)
    rounds = [(key, left if i % 2 == 0 else right) for i, key in enumerate(round_keys(seed))]
    if backwards:
        rounds.reverse()
    steps = F.array(*[F.struct(F.lit(k).cast("long").alias("key"), F.lit((1 << b) - 1).cast("long").alias("mask")) for k, b in rounds])
    first, second = F.shiftright(x, right), x.bitwiseAND(F.lit((1 << right) - 1))

    def forward(at, step):
        return F.struct(at["r"].alias("l"), at["l"].bitwiseXOR(_mix(at["r"], step["key"]).bitwiseAND(step["mask"])).alias("r"))

    def back(at, step):
        return F.struct(at["r"].bitwiseXOR(_mix(at["l"], step["key"]).bitwiseAND(step["mask"])).alias("l"), at["l"].alias("r"))

    start = F.struct(first.cast("long").alias("l"), second.cast("long").alias("r"))
    return F.aggregate(steps, start, back if backwards else forward,
                       lambda at: F.shiftleft(at["l"], right).bitwiseOR(at["r"]))


def walk(x: Column, n: int, seed: int, backwards: bool = False) -> Column:
    """Up to WALK passes, as long as the number is not below n."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x,
                       lambda p, _: F.when(p < F.lit(n), p).otherwise(feistel(p, n, seed, backwards)))


def permuted(df: DataFrame, number: str, n: int, seed: int, out: str, backwards: bool = False) -> DataFrame:
    """df with the permuted number; walks on until every row is below n."""
    done = materialize(df.withColumn(out, walk(feistel(F.col(number), n, seed, backwards), n, seed, backwards)), "walk")
    while done.filter(F.col(out) >= n).limit(1).count():
        done = materialize(done.withColumn(out, walk(F.col(out), n, seed, backwards)), "walk")
    return done


def place_of(df: DataFrame, number: str, n: int, shards: int, seed: int) -> DataFrame:
    """df with shard and slot of each row number."""
    placed = permuted(df, number, n, seed, "_place")
    return placed.withColumn("shard", (F.col("_place") % shards).cast("int")).withColumn(
        "slot", F.expr(f"_place div {shards}")).drop("_place")


def number_at(df: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """df of (shard, slot) with the row number that lies there."""
    placed = df.withColumn("_place", (F.col("slot") * shards + F.col("shard")).cast("long"))
    return permuted(placed, "_place", n, seed, "row_number", backwards=True).drop("_place")


def numbered(df: DataFrame, keys: list[str], out: str = "row_number") -> DataFrame:
    """df with gapless numbers from 0 in the order of keys, without a single-task sort.

    Range partitions are sorted on their own; each row's number is its place in the partition plus
    the rows of the partitions before it.  The counts are one row per partition.
    """
    placed = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (placed.withColumn("_part", part).join(counts, "_part")
            .withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_at", "_before"))


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = materialize(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                                     F.crc32(text.cast("binary")).alias("text_crc32")), "sizes")
    copies = narrow.withColumn("_copy", F.monotonically_increasing_id())
    rows = numbered(copies, ["doc_id", "size", "text_crc32", "_copy"]).drop("_copy")
    return place_of(rows, "row_number", narrow.count(), shards, seed)
