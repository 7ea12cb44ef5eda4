"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Vectors of whole numbers are sorted by label with a range shuffle and cut into blocks of at most ROWS;
each block stores its sorted list of every dimension once.  An anchor reads the lists of a block in
step: from the largest value down where its own component is positive, from the smallest up where it is
negative.  Each vector met for the first time is scored exactly by random access.  The threshold is the
score that a vector holding every list's last value read would have; no unmet vector can score more.  Each
window of scores [low, high] keeps its best k; reading stops once the threshold is strictly below
the k-th score of every window (a tie could still have a smaller vec_id), or below its low end.

Two passes use this.  Positives: the one window of all scores, among rows of the anchor's label; an
equality join on (dim, label) picks the blocks that hold the label.  Negatives: one window for
each positive, among rows of other labels in all blocks; anchors meet blocks by (dim, slot), a slot being
about SLOT blocks.  What a task has found for an anchor carries over to its next blocks, and the bests of
different tasks are ranked together, so a label that holds a third of all rows is spread over its blocks.

Memory: a task holds one block with its lists, one block of anchors and their windows.

Defined results: components become floor(scale * x); rows with a null id, label or vector, with null
or non-finite components (or such as pass a double when scaled) take no part; empty and zero vectors do; vectors meet
only those of their own number of components; rows with the anchor's id are never its partners; rows that repeat
another id count each; a repeated anchor row is answered each time; an anchor without positives, a positive without
negatives, and an empty table give no rows; a product beyond a long counts as the largest or
smallest long; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.vectors import EXACT, MOST, cut, matrix, numbered, products
from ledgerloom.session import materialize

ROWS = 4096
ANCHORS = 256
SLOT = 4
STEP = 64  # entries read of each list before the first look at the threshold; each time twice as many more


def _packed(rows: DataFrame, most: int, lists: bool, windows: bool) -> DataFrame:
    """Blocks of rows in the order of their label; with sorted lists, or with the windows of the column positives."""
    order = [F.col(c) for c in ("dim", "label", "row")]
    names = ["dim", "block", "n", "labels", "row", "vec_id", "label", "x", *["lists" for _ in range(lists)], *[f"w_{c}" for c in ("at", "id", "score") if windows]]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, b in enumerate(cut(batches, most)):
            values = [*(b.longs[c].tobytes() for c in ("row", "vec_id", "label")), b.x.tobytes()]
            if lists:
                values.append(np.ascontiguousarray(np.argsort(b.x, axis=0, kind="stable").T.astype(np.int32)).tobytes())
            if windows:
                held = [(at, p["vec_id"], p["score"]) for at, one in enumerate(b.table.column("positives").to_pylist()) for p in one]
                values += [np.array([h[j] for h in held], np.int64).tobytes() for j in range(3)]
            head = [pa.array([b.dim], pa.int32()), pa.array([(part << 32) + i]), pa.array([len(b.norm)], pa.int32()), pa.array([np.unique(b.longs["label"]).tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*head, *[pa.array([v], pa.binary()) for v in values]], names)

    kinds = ["int", "long", "int", "array<long>", *["binary" for _ in names[4:]]]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


class Candidates:
    """A block with its lists: order[d] are the block's rows by rising component d."""

    def __init__(self, dim: int, n: int, vec_id: bytes, label: bytes, x: bytes, lists: bytes):
        self.ids, self.label, self.x = np.frombuffer(vec_id, np.int64), np.frombuffer(label, np.int64), matrix(x, dim, n)
        self.order = np.frombuffer(lists, np.int32).reshape(dim, n)
        self.most = np.abs(self.x).max(initial=0) * max(dim, 1)


class Window:
    """The best k (score, vec_id) with a score from low to high."""

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k = low, high, k
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def push(self, score: np.ndarray, ids: np.ndarray) -> None:
        inside = (score >= self.low) & (score <= self.high)
        if len(self.score) == self.k:
            inside &= score >= self.score[-1]
        if inside.any():
            score, ids = np.append(self.score, score[inside]), np.append(self.ids, ids[inside])
            best = np.lexsort((ids, -score))[:self.k]
            self.score, self.ids = score[best], ids[best]

    def closed(self, threshold: float) -> bool:
        return threshold < self.low or (len(self.score) == self.k and threshold < self.score[-1])


def threshold_search(q: np.ndarray, block: Candidates, allowed: np.ndarray, windows: list[Window]) -> None:
    """Read the block's lists until no window of the anchor q can change."""
    n = len(block.ids)
    up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
    exact = np.abs(q).max(initial=0) * block.most < EXACT
    met, depth, step = np.zeros(n, bool), 0, STEP
    while depth < n:
        # Beyond EXACT the threshold could be rounded, so everything is read; an anchor of zeros has no lists to read.
        end = min(n, depth + step) if exact and len(up) + len(down) else n
        new = np.zeros(n, bool)
        if end == n:
            new[:] = True
        else:
            new[block.order[up, n - end:n - depth]] = True
            new[block.order[down, depth:end]] = True
        new &= ~met
        met |= new
        rows = np.flatnonzero(new & allowed)
        if len(rows):
            score = (block.x[rows] @ q).astype(np.int64) if exact else products(q[None, :], block.x[rows])[0]
            for w in windows:
                w.push(score, block.ids[rows])
        if end == n:
            return
        threshold = q[up] @ block.x[block.order[up, n - end], up] + q[down] @ block.x[block.order[down, end - 1], down]
        if all(w.closed(threshold) for w in windows):
            return
        depth, step = end, 2 * step


class Anchors:
    """A block of anchors and their windows."""

    def __init__(self, dim: int, n: int, row: bytes, vec_id: bytes, label: bytes, x: bytes):
        self.row, self.ids, self.label = (np.frombuffer(v, np.int64) for v in (row, vec_id, label))
        self.x = matrix(x, dim, n)
        self.windows: list[list[Window]] = [[] for _ in self.ids]
        self.given: list[tuple[int, int, int]] = []  # place of the anchor, id and score of a positive

    def meet(self, block: Candidates, same: bool) -> None:
        for i, windows in enumerate(self.windows):
            allowed = ((block.label == self.label[i]) == same) & (block.ids != self.ids[i])
            if windows and allowed.any():
                threshold_search(self.x[i], block, allowed, windows)


def _positives(anchors: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """row, positives: the k best other rows of each anchor's label, best first."""
    pairs = anchors.select("dim", F.col("block").alias("a_block"), F.explode("labels").alias("one")).join(blocks.select("dim", "block", F.explode("labels").alias("one")), ["dim", "one"])
    pairs = pairs.select("a_block", "block").distinct()

    def start(a: Anchors, _: pa.RecordBatch, __: int) -> None:
        a.windows = [[Window(-MOST, MOST, k)] for _ in a.ids]

    def rows(a: Anchors) -> pa.RecordBatch:
        found = [(a.row[i], v, s) for i, (w,) in enumerate(a.windows) for v, s in zip(w.ids, w.score, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["row", "vec_id", "score"])

    given = anchors.select(F.col("block").alias("a_block"), *[F.col(c).alias(f"a_{c}") for c in _ANCHOR]).join(pairs, "a_block")
    found = _met(given.join(blocks.drop("labels"), "block"), True, start, rows, "row long, vec_id long, score long")
    ranked = found.selectExpr("*", "row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place").filter(F.col("place") <= k)
    return ranked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))


_ANCHOR = ("dim", "n", "row", "vec_id", "label", "x")
_WINDOW = ("w_at", "w_id", "w_score")


def _met(tiles: DataFrame, same: bool, start, rows, schema: str) -> DataFrame:
    """Anchors' blocks meet candidates' blocks; start gives a block of anchors its windows, rows what was found."""
    given, own = [f"a_{c}" for c in _ANCHOR], ["dim", "n", "vec_id", "label", "x", "lists"]
    windows = [c for c in _WINDOW if c in tiles.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, a = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if (block := batch.column("a_block")[i].as_py()) != current:
                    if a:
                        yield rows(a)
                    current, a = block, Anchors(*(batch.column(c)[i].as_py() for c in given))
                    start(a, batch, i)
                a.meet(Candidates(*(batch.column(c)[i].as_py() for c in own)), same)
        if a:
            yield rows(a)

    return tiles.sortWithinPartitions("a_block").select("a_block", *given, *windows, *own).mapInArrow(run, schema)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by every.  A negative of a positive scores from low to high per
    cent of it.
    """
    good = materialize(numbered(vectors.filter(F.col("label").isNotNull()), scale, "label"), "vectors")
    blocks = materialize(_packed(good, rows, True, False), "blocks")
    asked = good.filter(F.col("vec_id") % every == 0)
    liked = materialize(_positives(materialize(_packed(asked, anchors, False, False), "anchors"), blocks, positives), "positives")
    windowed = _packed(asked.join(liked, "row"), anchors, False, True)
    slots = blocks.groupBy("dim").agg(F.ceil(F.count("*") / SLOT).alias("slots"))
    placed = blocks.drop("labels", "row").join(slots, "dim").withColumn("slot", F.pmod(F.xxhash64("block"), F.col("slots"))).drop("slots")
    sent = windowed.join(slots, "dim").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    sent = sent.select("slot", F.col("block").alias("a_block"), *[F.col(c).alias(f"a_{c}") for c in _ANCHOR], *_WINDOW)
    tiles = sent.join(placed, (sent["a_dim"] == placed["dim"]) & (sent["slot"] == placed["slot"]))

    def start(a: Anchors, batch: pa.RecordBatch, i: int) -> None:
        at, ids, score = (np.frombuffer(batch.column(c)[i].as_py(), np.int64).tolist() for c in _WINDOW)
        a.given = list(zip(at, ids, score, strict=True))
        for one, _, s in a.given:
            a.windows[one].append(Window(max(-(-low * s // 100), -MOST), min(high * s // 100, MOST), negatives))

    def found(a: Anchors) -> pa.RecordBatch:
        out, place = [], [0] * len(a.ids)
        for at, positive, score in a.given:
            w = a.windows[at][place[at]]
            out += [(a.row[at], place[at], a.ids[at], positive, score, v, s) for v, s in zip(w.ids, w.score, strict=True)]
            place[at] += 1
        return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(7)], names)

    names = ["row", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    best = _met(tiles, False, start, found, ", ".join(f"{n} long" for n in names))
    ranked = best.selectExpr("*", "row_number() OVER (PARTITION BY row, place ORDER BY negative_score DESC, negative_id) AS rank")
    return ranked.filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
