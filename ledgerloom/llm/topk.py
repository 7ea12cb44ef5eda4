"""Exact top-k by integer inner product, by buckets of similar length.

Vectors are sorted by length with a range shuffle and cut into buckets of at most ROWS in which no
vector is shorter than RATIO times the longest.  Blocks of queries first meet a few buckets of the
greatest lengths, which gives each query a floor: the k-th score found so far.  A query with floor t and
length |q| has in a bucket the local cosine threshold t / (|q| * the bucket's longest): above 1, the
bucket cannot hold an answer, and a block of queries is not even sent to buckets that are pruned for
all of them.  In the other buckets a query is answered by one of two ways, whichever leaves fewer vectors:

* length: only the bucket's first vectors, those of length t / |q| or more, sorted as they are;
* coordinates: for the FOCUS largest coordinates of the query, the cosine threshold bounds the
  coordinate of a (unit) vector, an interval of the bucket's sorted coordinate list; the smallest
  interval's vectors are checked against the others.

What is left is verified by exact products and enters the query's best k, whose floor rises from
bucket to bucket in the task, longest first.  The bests of different tasks are ranked together at the end.
Nothing that reaches the floor is pruned, so recall is 1.

Queries and buckets meet in slots: the buckets of a level of length, longest first, are dealt to slots of at most
HELD bytes, at least SLOTS slots in all if there are as many buckets.  Blocks of queries are sent to slots, buckets once
to their own; a task reads a slot's buckets first and then one block of queries after the other, so no pair of block
and bucket is ever a row.  What is sent grows with the table as long as SLOTS slots hold it, and beyond that with queries times slots.
Memory: a task holds the buckets of a slot, one block of queries and their products; the driver, and each task as a
broadcast, the place of each bucket (a few numbers for some ROWS vectors) and the levels, no vector.

Defined results: components become floor(scale * x); vectors that are null or hold null or non-finite
components (or such as pass a double when scaled) and rows without id take no part; zero and empty vectors do; vectors
meet only those of their own number of components; a query gets all candidates if there are fewer than k;
rows that repeat a vec_id are candidates of their own, but not of queries with that id; a query row that is repeated
gets its answer as often; a product beyond a long counts as the largest or smallest long; an empty
table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.vectors import cut, first_of, matrix, numbered, products
from ledgerloom.session import materialize

ROWS = 4096
QUERIES = 512
RATIO = 0.9
FOCUS = 4
SLOTS = 12
HELD = 32 << 20
SLACK = 1e-9
_STATE = ("at", "found", "score")  # of each find: place of its query in the block, vec_id, score


def _blocks(rows: DataFrame, most: int, ratio: float | None) -> DataFrame:
    """dim, block, n, longest, row, vec_id, norm, x: rows in the order of their length, cut into blocks."""
    order = [F.col("dim"), F.col("norm").desc(), F.col("row")]
    names = ["dim", "block", "n", "longest", "row", "vec_id", "norm", "x"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, b in enumerate(cut(batches, most, ratio)):
            yield pa.RecordBatch.from_arrays([pa.array([b.dim], pa.int32()), pa.array([(part << 32) + i]), pa.array([len(b.norm)], pa.int32()), pa.array([float(b.norm[0])]),
                                              *[pa.array([v.tobytes()]) for v in (b.longs["row"], b.longs["vec_id"], b.norm, b.x)]], names)

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(pack, "dim int, block long, n int, longest double, row binary, vec_id binary, norm binary, x binary")


def _level(longest: Column) -> Column:
    return F.when(longest > 0, F.floor(F.log(longest) / -float(np.log(RATIO)))).otherwise(F.lit(-(1 << 31))).cast("long")


def _places(buckets: DataFrame) -> DataFrame:
    """dim, level, block, n, longest, slot: buckets of a level, longest first, in slots of at most HELD bytes or one bucket."""
    rows = buckets.select("dim", "level", "block", "n", "longest").withColumn("bytes", F.col("n").cast("long") * F.greatest("dim", F.lit(1)) * 8)
    share = F.greatest(F.least(F.lit(HELD), F.sum("bytes") / SLOTS), F.max("bytes")).cast("long").alias("share")
    rows = rows.join(F.broadcast(rows.groupBy("dim").agg(share)), "dim")
    upto = F.sum("bytes").over(Window.partitionBy("dim", "level").orderBy(F.col("longest").desc(), "block").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("slot", F.floor((upto - F.col("bytes")) / F.col("share"))).drop("bytes", "share")


class Bucket:
    def __init__(self, dim: int, n: int, vec_id: bytes, norm: bytes, x: bytes):
        self.ids, self.norm, self.x = np.frombuffer(vec_id, np.int64), np.frombuffer(norm, np.float64), matrix(x, dim, n)
        self._lists = None

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors, the order of each coordinate, and the sorted coordinates."""
        if self._lists is None:
            unit = self.x / np.where(self.norm == 0, 1, self.norm)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self._lists = unit, order, np.take_along_axis(unit, order, axis=0)
        return self._lists


class Queries:
    """A block of queries and the best k finds of each so far."""

    def __init__(self, dim: int, n: int, row: bytes, vec_id: bytes, norm: bytes, x: bytes, k: int, state: tuple[bytes, ...] | None = None):
        self.k, self.row, self.ids, self.norm, self.x = k, np.frombuffer(row, np.int64), np.frombuffer(vec_id, np.int64), np.frombuffer(norm, np.float64), matrix(x, dim, n)
        self.at, self.found, self.score = (np.frombuffer(s, np.int64) for s in state or (b"", b"", b""))
        self.old = np.ones(len(self.at), bool)

    def floor(self) -> np.ndarray:
        """The score to reach, as doubles rounded down; minus infinity while a query has fewer than k."""
        n = np.bincount(self.at, minlength=len(self.ids))
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.at, self.score)
        return np.where(n >= self.k, np.nextafter(least.astype(np.float64), -np.inf), -np.inf)

    def needed(self, floor: np.ndarray) -> np.ndarray:
        """The least length of a vector that reaches the floor."""
        with np.errstate(over="ignore"):
            return np.where(self.norm > 0, floor / np.where(self.norm > 0, self.norm, 1) * (1 - np.sign(floor) * SLACK), -np.inf)

    def push(self, at: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        at, found, score = np.concatenate([self.at, at]), np.concatenate([self.found, found]), np.concatenate([self.score, score])
        old = np.append(self.old, np.zeros(len(at) - len(self.old), bool))
        best = first_of(at, score, found, self.k)
        self.at, self.found, self.score, self.old = at[best], found[best], score[best], old[best]

    def meet(self, bucket: Bucket) -> None:
        floor = self.floor()
        need = self.needed(floor)
        n = len(bucket.ids)
        reach = n - np.searchsorted(bucket.norm[::-1], need, "left")
        by_length = reach > 0
        longest = bucket.norm[0]
        local = np.where((need > 0) & (longest > 0) & np.isfinite(longest), need / max(longest, 1e-300), 0)
        for i in np.flatnonzero(by_length & (local > 0) & (local <= 1)):
            rows = self._by_coordinates(i, local[i], bucket)
            if rows is not None and len(rows) < reach[i]:
                by_length[i] = False
                self._verify(np.array([i]), rows, bucket, floor)
        left = np.flatnonzero(by_length)
        if len(left):
            self._verify(left, np.arange(reach[left].max()), bucket, floor)

    def _by_coordinates(self, i: int, local: float, bucket: Bucket) -> np.ndarray | None:
        """Places in the bucket whose focus coordinates allow the cosine; None if the lists save too little."""
        focus = np.argsort(-np.abs(self.x[i]))[:FOCUS]
        angle, wide = np.arccos(np.clip(self.x[i, focus] / self.norm[i], -1, 1)), np.arccos(min(local, 1))
        low, high = np.cos(np.minimum(np.pi, angle + wide)) - SLACK, np.cos(np.maximum(0, angle - wide)) + SLACK
        if (high - low).min() > 1:
            return None
        unit, order, listed = bucket.lists()
        start = [np.searchsorted(listed[:, d], v, "left") for d, v in zip(focus, low, strict=True)]
        end = [np.searchsorted(listed[:, d], v, "right") for d, v in zip(focus, high, strict=True)]
        least = int(np.argmin(np.subtract(end, start)))
        rows = order[start[least]:end[least], focus[least]]
        inside = unit[np.ix_(rows, focus)]
        return rows[((inside >= low) & (inside <= high)).all(axis=1)]

    def _verify(self, at: np.ndarray, rows: np.ndarray, bucket: Bucket, floor: np.ndarray) -> None:
        if not len(rows):
            return
        score = products(self.x[at], bucket.x[rows])
        ids = bucket.ids[rows]
        own = self.ids[at][:, None] == ids[None, :]
        keep = (score >= floor[at][:, None]) & ~own
        if len(rows) > self.k:
            most = np.where(own, np.iinfo(np.int64).min, score)
            keep &= score >= np.partition(most, len(rows) - self.k, axis=1)[:, len(rows) - self.k][:, None]
        r, c = np.nonzero(keep)
        self.push(at[r], ids[c], score[r, c])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each vector whose id is divisible by every."""
    good = materialize(numbered(vectors, scale), "vectors")
    buckets = materialize(_blocks(good, rows, RATIO).withColumn("level", _level(F.col("longest"))), "buckets")
    places = _places(buckets)
    # One entry for each level of length: a level is a power of RATIO, so the list is bounded by the range of doubles.
    levels = places.groupBy("dim", "level").agg((F.max("slot") + 1).alias("slots"), F.max("longest").alias("longest"), F.sum("n").alias("n"))
    levels = levels.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("level", "slots", "longest", "n")), False).alias("levels"))
    # Queries begin where the longest vectors are, in the first level that is not all but empty.
    levels = F.broadcast(levels.withColumn("own", F.coalesce(F.get(F.filter("levels", lambda x: x["n"] >= rows), F.lit(0)), F.col("levels")[0])))
    given = buckets.join(F.broadcast(places.select("block", "slot")), "block")
    asked = _blocks(good.filter(F.col("vec_id") % every == 0), queries, None).join(levels, "dim")
    asked = asked.withColumn("level", F.col("own.level")).withColumn("slot", F.pmod(F.xxhash64("block"), F.col("own.slots")))
    key = ["dim", "level", "slot"]
    q_columns = ["dim", "n", "row", "vec_id", "norm", "x"]
    b_columns = ["dim", "n", "vec_id", "norm", "x"]

    def met(batches: Iterator[pa.RecordBatch], seeded: bool) -> Iterator[tuple[tuple, int, Queries]]:
        """Slot, number and state of each block of queries after the buckets of that slot."""
        current, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                own = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                slot = tuple(own[c] for c in key)
                if slot != current:
                    current, held = slot, []
                if own["block"] is None:
                    held.append(Bucket(*(own[c] for c in b_columns)))
                    continue
                q = Queries(*(own[c] for c in q_columns), k, tuple(own[c] for c in _STATE) if seeded else None)
                for bucket in held:
                    q.meet(bucket)
                yield slot, own["block"], q

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, level, slot), block, q in met(batches, False):
            need = q.needed(q.floor()).min()
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([level]), pa.array([slot]), pa.array([block]), pa.array([float(need)]), pa.array([len(q.ids)], pa.int32()),
                 *[pa.array([v.tobytes()]) for v in (q.row, q.ids, q.norm, q.x, q.at, q.found, q.score)]],
                ["dim", "own_level", "own_slot", "block", "need", *q_columns[1:], *_STATE])

    def finds(q: Queries, which: np.ndarray) -> pa.RecordBatch:
        at = q.at[which]
        return pa.RecordBatch.from_arrays([pa.array(q.row[at]), pa.array(q.ids[at]), pa.array(q.found[which]), pa.array(q.score[which])], ["row", "query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, q in met(batches, True):
            yield finds(q, ~q.old)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q = Queries(*(batch.column(c)[i].as_py() for c in q_columns), k, tuple(batch.column(c)[i].as_py() for c in _STATE))
                yield finds(q, q.old)

    def tiles(blocks: DataFrame, theirs: DataFrame, *more: str) -> DataFrame:
        """Rows of each slot together: its buckets, longest first, then the blocks of queries sent to it."""
        none = [F.lit(None).cast("binary").alias(c) for c in more]
        own = theirs.select(*key, F.lit(None).cast("long").alias("block"), "longest", "n", "row", "vec_id", "norm", "x", *none)
        both = own.unionByName(blocks.select(*key, "block", F.lit(None).cast("double").alias("longest"), *q_columns[1:], *more))
        return both.repartition(*key).sortWithinPartitions(*key, F.col("block").asc_nulls_first(), F.col("longest").desc())

    binaries = ", ".join(f"{c} binary" for c in (*q_columns[2:], *_STATE))
    begin = given.join(levels.select("dim", F.col("own.level").alias("own_level")), "dim").filter("level = own_level")
    state = tiles(asked, begin).mapInArrow(seed, f"dim int, own_level long, own_slot long, block long, need double, n int, {binaries}")
    begun = materialize(state, "begun")
    alive = begun.join(levels, "dim").withColumn("l", F.explode(F.filter("levels", lambda x: x["longest"] >= F.col("need"))))
    alive = alive.select(*begun.columns, "l.level", "l.slots").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    alive = alive.filter("level <> own_level OR slot <> own_slot")
    schema = "row long, query_id long, vec_id long, score long"
    found = tiles(alive, given, *_STATE).mapInArrow(search, schema).unionByName(begun.select(*q_columns, *_STATE).mapInArrow(seeds, schema))
    ranked = found.selectExpr("query_id", "vec_id", "score", "row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank")
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
