"""Nearest neighbours by largest inner product, exact, by a block matrix join.

Every vector is stored as int8 steps of its own scale.  The table is dealt into blocks of ROWS vectors
and the queries into blocks of QUERIES; each pair of blocks is one tile, met by an equality join on
the tile's number, so pairs of vectors never become rows.  A tile multiplies its int8 matrices (in
slices of EXACT components, whose products are exact in 32-bit floats, added up in doubles) and knows each product's error bound from the
norms of the two vectors and of what rounding took from them.  A vector survives for a query if its
largest possible product reaches the k-th best guaranteed one, counting the query's heap from the
task's earlier tiles.  Survivors are computed again from the original floats in double precision, in
the order of the components, and enter the query's heap of k, ordered by score and then smaller
vec_id.  Heaps of different tasks are merged by a last top-k.  No neighbour can be lost, so recall is 1.

Memory: a tile has ROWS x QUERIES products; a task keeps one query block's heaps.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part; vectors meet only those of their own length; a query gets all candidates if there are fewer
than k; rows that repeat a vec_id are candidates of their own, but not of a query with that id, and
each asks for itself, so that its id has k rows for each of them; components keep their kind, float or double; an
empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ledgerloom.session import materialize

ROWS = 4096
QUERIES = 1024
SLACK = 1e-6
EXACT = 1040  # products of this many int8 pairs stay below 2^24


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def block_counts(vectors: DataFrame, rows: int) -> DataFrame:
    """dim, n_blocks: blocks of about rows vectors; one row for each length of vectors."""
    return materialize(vectors.groupBy("dim").agg(F.ceil(F.count("*") / rows).alias("n_blocks")), "counts")


def blocks(vectors: DataFrame, counts: DataFrame, kind: type) -> DataFrame:
    """dim, block, row numbers, ids, data: vectors of equal length packed as raw numbers of a kind."""
    dealt = vectors.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), "n_blocks"))

    def pack(table: pa.Table) -> pa.Table:
        data = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        numbers = [pa.array([table.column(c).to_numpy().astype(np.int64).tobytes()]) for c in ("row", "vec_id")]
        head = [pa.array(table.column(c)[:1].to_pylist(), t) for c, t in (("dim", pa.int32()), ("block", pa.int64()))]
        return pa.Table.from_arrays([*head, *numbers, pa.array([data.tobytes()])], ["dim", "block", "numbers", "ids", "data"])

    return dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block long, numbers binary, ids binary, data binary")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 steps, scale, norm and norm of the rounding error of each row."""
    wide = x.astype(np.float64)
    scale = np.abs(wide).max(axis=1) / 127
    steps = np.rint(wide / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(wide - steps * scale[:, None], axis=1)
    return steps, scale, np.linalg.norm(wide, axis=1), error


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added up in the order of the components."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d].astype(np.float64) * q[:, d].astype(np.float64)
    return total


class Heaps:
    """The k best (score, vec_id) of each query of a block."""

    def __init__(self, numbers: np.ndarray, q_ids: np.ndarray, k: int):
        self.numbers, self.q_ids, self.k = numbers, q_ids, k
        self.scores = np.full((len(q_ids), k), -np.inf)
        self.ids = np.full((len(q_ids), k), np.iinfo(np.int64).max)
        self.used = np.zeros((len(q_ids), k), bool)

    def floor(self) -> np.ndarray:
        return np.where(self.used.all(axis=1), self.scores.min(axis=1), -np.inf)

    def push(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """New pairs, sorted by query."""
        for part in np.split(np.arange(len(query)), np.flatnonzero(np.diff(query)) + 1):
            if len(part):
                r = query[part[0]]
                s = np.concatenate([self.scores[r][self.used[r]], scores[part]])
                i = np.concatenate([self.ids[r][self.used[r]], ids[part]])
                best = np.lexsort((i, -s))[:self.k]
                self.scores[r, :len(best)], self.ids[r, :len(best)], self.used[r, :len(best)] = s[best], i[best], True

    def rows(self) -> pa.RecordBatch:
        r, c = np.nonzero(self.used)
        columns = [self.numbers[r], self.q_ids[r], self.ids[r, c], self.scores[r, c]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query", "query_id", "vec_id", "score"])


def steps_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the int8 rows of a and b, exact."""
    total = np.zeros((len(a), len(b)))
    for first in range(0, a.shape[1], EXACT):
        total += a[:, first:first + EXACT].astype(np.float32) @ b[:, first:first + EXACT].astype(np.float32).T
    return total


def tile(heaps: Heaps, q: tuple, q_raw: np.ndarray, ids: np.ndarray, x_raw: np.ndarray) -> None:
    """One tile's survivors into the heaps of its queries."""
    steps, scale, norm, error = quantised(x_raw)
    q_steps, q_scale, q_norm, q_error = q
    about = steps_product(q_steps, steps) * q_scale[:, None] * scale[None, :]
    # |xy - x'y'| = |(x - x')y + x'(y - y')| <= |x - x'| |y| + (|x| + |x - x'|) |y - y'|
    bound = q_error[:, None] * norm[None, :] + (q_norm + q_error)[:, None] * error[None, :]
    bound = bound * (1 + SLACK) + SLACK * q_norm[:, None] * norm[None, :]
    own = heaps.q_ids[:, None] == ids[None, :]
    low = np.where(own, -np.inf, about - bound)
    if len(ids) > heaps.k:
        least = np.partition(low, len(ids) - heaps.k, axis=1)[:, len(ids) - heaps.k]
    else:
        least = np.full(len(low), -np.inf)
    keep = (about + bound >= np.maximum(least, heaps.floor())[:, None]) & ~own
    for first in range(0, len(keep), 64):  # a bounded number of pairs at a time
        row, col = np.nonzero(keep[first:first + 64])
        if len(row):
            heaps.push(row + first, ids[col], exact(x_raw[col], q_raw[row + first]))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each vector whose id is divisible by every."""
    kind = np.float64 if vectors.schema["embedding"].dataType.elementType == DoubleType() else np.float32
    good = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"))
    counts = block_counts(good, rows)
    asked = good.filter(F.col("vec_id") % every == 0)
    asked = blocks(asked, block_counts(asked, queries), kind).select(
        "dim", F.col("block").alias("q_block"), F.col("numbers").alias("q_numbers"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    asked = asked.join(counts, "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    tiles = asked.join(blocks(good, counts, kind), ["dim", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heaps = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, q_block, numbers, q_ids, q_data, ids, data = (c[i].as_py() for c in batch.columns)
                if (dim, q_block) != current:
                    if heaps:
                        yield heaps.rows()
                    current, heaps = (dim, q_block), Heaps(np.frombuffer(numbers, np.int64), np.frombuffer(q_ids, np.int64), k)
                    q_raw = np.frombuffer(q_data, kind).reshape(-1, dim)
                    q = quantised(q_raw)
                tile(heaps, q, q_raw, np.frombuffer(ids, np.int64), np.frombuffer(data, kind).reshape(-1, dim))
        if heaps:
            yield heaps.rows()

    dealt = tiles.sortWithinPartitions("dim", "q_block").select("dim", "q_block", "q_numbers", "q_ids", "q_data", "ids", "data")
    found = dealt.mapInArrow(run, "query long, query_id long, vec_id long, score double")
    ranked = found.selectExpr("query_id", "vec_id", "score", "row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank")
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
