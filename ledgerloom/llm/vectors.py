"""Vectors as whole numbers, packed into blocks that stay in the order of a range shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = 2.0 ** 53
MOST = 2 ** 63 - 1


def finite(vector: Column, scale: int) -> Column:
    """Not null, and every component times scale a finite double."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))


def numbered(vectors: DataFrame, scale: int, *more: str) -> DataFrame:
    """row, vec_id, the columns more as longs, dim, norm, x: floor(scale * component) as raw doubles; rows that take part only.

    norm is the length of x.  Row numbers tell rows with equal ids apart.
    """
    good = vectors.filter(finite(F.col("embedding"), scale) & F.col("vec_id").isNotNull())
    rows = good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
                       *[F.col(c).cast("long").alias(c) for c in more], F.col("embedding").cast("array<double>").alias("embedding"))
    names = ["row", "vec_id", *more, "dim", "norm", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            x = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
            ends = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), out=ends[1:])
            some = np.flatnonzero(np.diff(ends))
            norm = np.zeros(batch.num_rows)
            if len(some):
                most = np.maximum.reduceat(np.abs(x), ends[some])
                part = x / np.repeat(np.where(most == 0, 1, most), np.diff(ends)[some])
                norm[some] = most * np.sqrt(np.add.reduceat(part * part, ends[some]))
            raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends * np.int32(8)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(ends)), pa.array(norm), raw], names)

    kinds = ["long", "long", *["long" for _ in more], "int", "double", "binary"]
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


class Block:
    """Consecutive rows of one dim: the table, its long columns by name, norm, and x as a matrix."""

    def __init__(self, table: pa.Table):
        self.table = table = table.combine_chunks()
        self.dim = table.column("dim")[0].as_py()
        self.norm = table.column("norm").to_numpy()
        self.longs = {f.name: table.column(f.name).to_numpy() for f in table.schema if pa.types.is_int64(f.type)}
        self.x = matrix(b"".join(table.column("x").to_pylist()), self.dim, len(self.norm))


def matrix(raw: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(rows, dim)


def cut(batches: Iterator[pa.RecordBatch], most: int, ratio: float | None = None) -> Iterator[Block]:
    """Blocks of at most `most` rows of one dim; with a ratio, no norm below ratio times the block's first."""
    held: pa.Table | None = None

    def first_end(table: pa.Table) -> int:
        dim, norm = table.column("dim").to_numpy()[:most], table.column("norm").to_numpy()[:most]
        apart = dim != dim[0]
        if ratio is not None:
            apart |= norm < ratio * norm[0]
        return int(np.argmax(apart)) if apart.any() else len(dim)

    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        while held.num_rows >= most:
            end = first_end(held)
            yield Block(held.slice(0, end))
            held = held.slice(end)
    while held is not None and held.num_rows:
        end = first_end(held)
        yield Block(held.slice(0, end))
        held = held.slice(end)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and x as exact longs; beyond a long, the largest or smallest one."""
    most = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(x.shape[1], 1)
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in q], object).reshape(q.shape) @ np.array([[int(v) for v in row] for row in x], object).reshape(x.shape).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def first_of(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, by score descending, then vec_id."""
    order = np.lexsort((vec_id, -score, group))
    g = group[order]
    start = np.flatnonzero(np.diff(g, prepend=~g[:1]))
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]
