"""Near-duplicates by 64-bit SimHash and a byte-position inverted index.

A fingerprint has eight bytes.  Two fingerprints that differ in at most three bits share at least five
of the eight positional bytes, so they share all four bytes of at least one of fourteen fixed sets of
four positions: the sets are the blocks of a system in which any three positions lie together in one
block, and a block's complement is a block too.  The index therefore has one posting per set and
fingerprint, keyed by the set and its four bytes.  Postings alone under their key are dropped by a
count before anything is compared.  Inside a key's list shared positional bytes are tallied per pair;
pairs with fewer than five cannot be links, the others are verified by their differing bits.

Only different fingerprints are indexed, so copies cost nothing.  A list of more than LIST_LIMIT
fingerprints is dealt out once more: they agree in four bytes; links agree in a fifth one and, of the
six half-bytes left, in three at least.  One list per fifth byte and three half-bytes leaves twelve
free bits, so at most 4,096 different fingerprints, whatever the data.  From each list only a
spanning forest of its links is emitted, which has the same components as all links.

Defined results: a null, empty or blank text has fingerprint 0 and is linked like any other; fewer
words than a shingle are one shingle; repeated rows are copies; null ids never become a component's
id unless all its ids are null; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.components import components
from ledgerloom.session import materialize

SHINGLE = 3
DISTANCE = 3
LIST_LIMIT = 4096
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = 1 << 14


def _blocks() -> list[tuple[int, ...]]:
    """Sets of four of the positions 0-7 whose numbers have an exclusive-or of zero: 14 of them, any three positions lie in one."""
    return [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


BLOCKS = _blocks()


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """SimHash of the text's word shingles; a bit is set if it is set in over half of the hashes."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    ends = ends[width - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), _STEP):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + _STEP], ends[i:i + _STEP], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    bits = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the columns to carry."""
    own = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(own))
            prints = np.array([fingerprint(texts[i].as_py(), width) for i in range(len(texts))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*own, "fp"])

    schema = T.StructType([docs.schema[c] for c in own] + [T.StructField("fp", T.LongType())])
    return docs.select(*own, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _mask(bits: set[int]) -> int:
    """Signed long with the given bits."""
    value = sum(1 << i for i in bits)
    return value - (1 << 64) if value >> 63 else value


def _bits(positions: tuple[int, ...]) -> set[int]:
    return {8 * p + i for p in positions for i in range(8)}


def postings(prints: DataFrame) -> DataFrame:
    """block, key, fp: one posting per set of four positions; the key is the fingerprint's bytes there."""
    keys = [F.struct(F.lit(n).alias("block"), F.col("fp").bitwiseAND(F.lit(_mask(_bits(b)))).alias("key")) for n, b in enumerate(BLOCKS)]
    return prints.select(F.explode(F.array(*keys)).alias("posting"), "fp").select("posting.block", "posting.key", "fp")


def _finer(lists: DataFrame) -> DataFrame:
    """tag, key, fp of the long lists: a fifth byte and three of the six half-bytes left are shared too."""
    rows = []
    for n, block in enumerate(BLOCKS):
        rest = [p for p in range(8) if p not in block]
        for fifth in rest:
            halves = [{8 * p + h + i for i in range(4)} for p in rest if p != fifth for h in (0, 4)]
            rows += [(n, _mask(_bits((*block, fifth)).union(*three))) for three in combinations(halves, 3)]
    masks = lists.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "tag int, block int, mask long")
    # 14 sets x 4 bytes x 20 choices: the table has 1,120 rows, always.
    return lists.join(F.broadcast(masks), "block").select("tag", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _forest(members: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (smaller first met, other) of a spanning forest of the list; members differ."""
    left = np.arange(len(members))
    while len(left) > 1:
        root, left = left[:1], left[1:]
        front = root
        while len(front) and len(left):
            grown = []
            for i in range(0, len(front), 256):
                if not len(left):
                    break
                differ = members[front[i:i + 256], None] ^ members[None, left]
                shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
                linked = (shared >= 8 - DISTANCE) & (np.bitwise_count(differ) <= DISTANCE)
                hit = linked.any(axis=0)
                if hit.any():
                    to = front[i:i + 256][linked[:, hit].argmax(axis=0)]
                    for a, b in zip(to, left[hit], strict=True):
                        yield members[a], members[b]
                    grown.append(left[hit])
                    left = left[~hit]
            front = np.concatenate(grown) if grown else front[:0]


def _links(lists: DataFrame, keys: list[str]) -> DataFrame:
    """u, v: forests of lists that stand together and sorted in the partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            block = np.stack([c.to_numpy() for c in batch.columns])
            block = block if rest is None else np.concatenate([rest, block], axis=1)
            cut = np.flatnonzero((block[:-1, 1:] != block[:-1, :-1]).any(axis=0)) + 1
            whole, rest = (block[:, :cut[-1]], block[:, cut[-1]:]) if len(cut) else (block[:, :0], block)
            yield from emit(whole)
        if rest is not None:
            yield from emit(rest)

    def emit(block: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not block.shape[1]:
            return
        cut = np.flatnonzero((block[:-1, 1:] != block[:-1, :-1]).any(axis=0)) + 1
        found = [np.array(x, np.uint64) for part in np.split(block[-1].view(np.uint64), cut) for x in _forest(part)]
        if found:
            out = np.stack(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], ["u", "v"])

    return lists.select(*keys, "fp").sortWithinPartitions(*keys, "fp").mapInArrow(run, "u long, v long")


def links(prints: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """u, v: links between different fingerprints, as spanning forests of the index's lists."""
    index = postings(prints)
    counts = index.groupBy("block", "key").agg(F.count("*").alias("n")).filter("n > 1")
    lists = materialize(index.join(counts, ["block", "key"]), "lists")
    short = lists.filter(F.col("n") <= limit).repartition("block", "key")
    long = _finer(lists.filter(F.col("n") > limit))
    shared = long.groupBy("tag", "key").agg(F.count("*").alias("m")).filter("m > 1")
    long = long.join(shared, ["tag", "key"]).repartition("tag", "key")
    return _links(short, ["block", "key"]).unionByName(_links(long, ["tag", "key"]))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, limit: int = LIST_LIMIT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable through links of at most DISTANCE bits), root (a fingerprint that names the component), carry."""
    stored = materialize(fingerprints(docs, width, carry), "fingerprints")
    first = stored.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(first.select("fp"), limit))
    named = first.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "root").select("fp", "component_id", "root")
    return stored.join(classes, "fp").select("doc_id", "fp", "component_id", "root", *carry)
