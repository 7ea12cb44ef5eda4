"""Packing of documents into sequences by a grouping genetic algorithm on islands.

Texts are turned into token ids in the tasks; only (document, piece, start, length, checksum) rows
leave them.  A document longer than a sequence is cut into whole sequences and a rest; pieces that
fill a sequence are done.  The others are dealt by a hash into cells of about CELL pieces, so a cell's
size does not depend on the data.  For each cell ISLANDS populations evolve from best-fit-decreasing
starts with different orders:

* crossover puts whole well-filled bins of one parent into the other, removes the other's bins that
  hold one of their documents, and best-fits the documents displaced by that, longest first;
* fitness is the mean square of the bins' filling, so full bins beside empty ones are better;
* after each epoch an island's best packing moves to the next island (a shuffle of one row per cell
  and island), where it replaces the worst.

The best packing of a cell is kept.  Bins that are not filled to OPEN are opened again: their pieces
go to cells of the next round, whole bins together, and the packing they come with is one of the
starts, so no round can add a sequence.  Rounds end when one cell is left or nothing was gained.

The tokenizer cuts texts at words first.  So the words of some documents are found at once in their bytes
and numbered as a column, each different one is tokenized (or remembered), and the ids are put together
by those numbers; texts with anything but common Latin characters go through the tokenizer as a whole.

Defined results: a null or empty text is the closing id alone; repeated rows are documents of their
own; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize

CAPACITY = 2048
CELL = 2048
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 3
POPULATION = 4
OPEN = 0.999
CHUNK = 1 << 22
_SPECIAL = re.compile(rb"<\|(?:start|end)oftext\|>")
_REMEMBERED = 1 << 19
_ASKED = 1000
# Bytes of texts that are cut here: ASCII that is printed or space, and the letters from A with grave to y with diaeresis.
_LETTERS = [*range(65, 91), *range(97, 123), 0xC3, *(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))]
_KIND = np.full(256, 3, np.uint8)  # 0: space, 1: of a word, 2: digit, 3: other
_KIND[[*range(9, 14), 32]], _KIND[_LETTERS], _KIND[48:58] = 0, 1, 2
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(9, 14), *range(32, 127), *_LETTERS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(65, 91), *(b for b in range(0x80, 0x9F) if b != 0x97)]] += 32
_ENDINGS = [b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"]  # of one token with an apostrophe before them


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word that the tokenizer cuts off: letters, single digits, other characters, 's and the like."""
    kind = _KIND[data]
    before = np.concatenate([[0], kind[:-1]])
    start = (kind > 0) & ((kind != before) | (kind == 2))
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    quote = np.flatnonzero(start & (data == 39))
    for ending in _ENDINGS:
        hit = quote
        for i, c in enumerate(ending, 1):
            hit = hit[padded[hit + i] == c]
        start[hit + 1] = False
        rest = hit + 1 + len(ending)
        rest = rest[rest < len(data)]
        start[rest[kind[rest] == 1]] = True
    first = np.flatnonzero(start)
    stop = np.flatnonzero(start[1:] | (kind[1:] == 0)) + 1
    return first, np.append(stop, len(data))[np.searchsorted(stop, first, "right")]


class Tokens(dict):
    """Ids of words as little-endian 32-bit numbers, remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Look up words, each as the tokenizer cuts it off, many in a call."""
        new = [w for w in words if w not in self]
        if len(self) + len(new) > _REMEMBERED:
            self.clear()
            new = words
        for i in range(0, len(new), _ASKED):
            part = new[i:i + _ASKED]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            which = found.word_ids
            if None not in which and len(set(which)) == len(part):
                cut = np.searchsorted(np.array(which), np.arange(len(part) + 1)) * 4
                raw = np.array(found.ids, "<u4").tobytes()
                self.update((w, raw[a:b]) for w, a, b in zip(part, cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            else:
                self.update((w, self.whole(w)) for w in part)

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        parts, place, out = [], [], [[] for _ in texts]
        for i, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            if not _PLAIN[data].all() or (b"<|" in text and _SPECIAL.search(text)):
                out[i].append(self.whole(text.decode()))
                continue
            while len(data):
                end = len(data)
                if end > CHUNK and len(space := np.flatnonzero(_KIND[data[:CHUNK]] == 0)):
                    end = space[-1] + 1
                parts.append(data[:end])
                place.append(i)
                data = data[end:]
        at = 0
        while at < len(parts):
            to, size = at + 1, len(parts[at])
            while to < len(parts) and size + len(parts[to]) <= CHUNK:
                size += len(parts[to])
                to += 1
            for i, ids in zip(place[at:to], self._together(parts[at:to]), strict=True):
                out[i].append(ids)
            at = to
        return [b"".join(x) for x in out]

    def _together(self, parts: list[np.ndarray]) -> list[bytes]:
        data = _LOWER[np.concatenate([x for part in parts for x in (part, np.array([32], np.uint8))])]
        first, stop = words_of(data)
        offsets = np.zeros(len(first) + 1, np.int32)
        np.cumsum(stop - first, out=offsets[1:])
        kept = data[_KIND[data] > 0]
        found = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(kept)).dictionary_encode()
        words = found.dictionary.to_pylist()
        self.learn(words)
        spelled = [self[w] for w in words]
        length = np.array([len(x) // 4 for x in spelled], np.int64)
        begin, which = np.cumsum(length) - length, found.indices.to_numpy()
        n = length[which]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(spelled), "<u4")[np.repeat(begin[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        cut = np.searchsorted(first, np.cumsum([len(p) + 1 for p in parts]))
        cut = np.append(0, np.concatenate([[0], ends])[cut])
        return [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


_OF_PROCESS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The tokens that this process remembers; Spark gives its Python workers many tasks one after the other."""
    if path not in _OF_PROCESS:
        _OF_PROCESS.clear()
        _OF_PROCESS[path] = Tokens(path)
    return _OF_PROCESS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32: every document's ids and a closing 0, cut at the capacity."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer)
        for batch in batches:
            which, piece, start, length, sums = [], [], [], [], []
            for i, ids in enumerate(tokens.of([t or b"" for t in batch.column(1).to_pylist()])):
                data = ids + b"\0\0\0\0"
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    which.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    found = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return materialize(found.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def best_fit(bins: list[list[int]], free: list[int], items: list[int], lengths: list[int], capacity: int) -> None:
    """Put each item into the open bin it fills best, or a new one."""
    order = sorted((f, b) for b, f in enumerate(free))
    for i in items:
        n = lengths[i]
        at = bisect_left(order, (n, -1))
        if at < len(order):
            f, b = order.pop(at)
            bins[b].append(i)
        else:
            f, b = capacity, len(bins)
            bins.append([i])
            free.append(f)
        free[b] = f - n
        if free[b]:
            insort(order, (free[b], b))


def fitness(free: list[int], capacity: int) -> float:
    fill = capacity - np.array(free)
    return float((fill / capacity) @ (fill / capacity) / len(free))


def cross(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> tuple[list[list[int]], list[int]]:
    """Well-filled bins of b, the bins of a that share no document with them, and what that displaces best-fitted."""
    fill = [sum(map(lengths.__getitem__, g)) for g in b]
    full = [k for k in sorted(range(len(b)), key=fill.__getitem__, reverse=True)[: max(1, len(b) // 2)] if rng.random() < 0.7] or [max(range(len(b)), key=fill.__getitem__)]
    bins = [list(b[k]) for k in full]
    taken = {i for g in bins for i in g}
    displaced = []
    for g in a:
        if taken.isdisjoint(g):
            bins.append(list(g))
        else:
            displaced += [i for i in g if i not in taken]
    # The worst bins are opened too, so that displaced documents meet others.
    free = [capacity - sum(map(lengths.__getitem__, g)) for g in bins]
    loose = sorted(range(len(bins)), key=free.__getitem__, reverse=True)[: 1 + len(bins) // 50]
    loose = {k for k in loose if free[k]}
    displaced += [i for k in loose for i in bins[k]]
    bins, free = [g for k, g in enumerate(bins) if k not in loose], [f for k, f in enumerate(free) if k not in loose]
    displaced.sort(key=lambda i: -lengths[i])
    best_fit(bins, free, displaced, lengths, capacity)
    return bins, free


def groups(assigned: np.ndarray) -> list[list[int]]:
    """Bins as lists, from each item's bin number."""
    order = np.argsort(assigned, kind="stable")
    cut = np.flatnonzero(np.diff(assigned[order])) + 1
    return [g.tolist() for g in np.split(order, cut)]


def numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, g in enumerate(bins):
        out[g] = k
    return out


def evolve(lengths: np.ndarray, start: list[np.ndarray], seed: int, capacity: int, generations: int, population: int) -> list[np.ndarray]:
    """Bin numbers of the packings after some generations, the best first."""
    rng, sizes = random.Random(seed), lengths.tolist()
    people = []
    for assigned in start:
        bins = groups(assigned)
        people.append((bins, [capacity - sum(map(sizes.__getitem__, g)) for g in bins]))
    while len(people) < population:
        blur = 0.0 if not people else 0.15
        items = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + blur * rng.random()))
        bins, free = [], []
        best_fit(bins, free, items, sizes, capacity)
        people.append((bins, free))
    people = [(len(p[0]), -fitness(p[1], capacity), p[0]) for p in people]
    people.sort(key=lambda p: p[:2])
    for _ in range(generations):
        for _ in range(2):
            a, b = rng.sample(range(min(len(people), population)), 2) if len(people) > 1 else (0, 0)
            bins, free = cross(people[a][2], people[b][2], sizes, capacity, rng)
            people.append((len(bins), -fitness(free, capacity), bins))
        people.sort(key=lambda p: p[:2])
        del people[population:]
    return [numbers(p[2], len(sizes)) for p in people]


_STATE = "cell long, island int, uids binary, lengths binary, people array<binary>, bins long, fit double"


def _cells(items: DataFrame) -> DataFrame:
    """cell, uids, lengths, given: the items of a cell, sorted, with the bins they come in, if any."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        given = table.column("bin").to_numpy(zero_copy_only=False)
        known = b"" if table.column("bin").null_count else np.unique(given.astype(np.int64), return_inverse=True)[1].astype(np.int32).tobytes()
        return pa.Table.from_arrays([table.column("cell")[:1], pa.array([table.column("uid").to_numpy().astype(np.int64).tobytes()]),
                                     pa.array([table.column("length").to_numpy().astype(np.int32).tobytes()]), pa.array([known])],
                                    ["cell", "uids", "lengths", "given"])

    return items.groupBy("cell").applyInArrow(pack, "cell long, uids binary, lengths binary, given binary")


def _epoch(state: DataFrame, epoch: int, capacity: int, generations: int, population: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cell, island, uids, lengths, people = (c[r].as_py() for c in batch.columns)
                sizes = np.frombuffer(lengths, np.int32)
                start = [np.frombuffer(p, np.int32) for p in people]
                done = evolve(sizes, start, hash((cell, island, epoch)), capacity, generations, population)
                fill = np.bincount(done[0], weights=sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cell]), pa.array([island], pa.int32()), pa.array([uids]), pa.array([lengths]), pa.array([[p.tobytes() for p in done]], pa.list_(pa.binary())),
                     pa.array([len(fill)]), pa.array([fitness((capacity - fill).tolist(), capacity)])],
                    ["cell", "island", "uids", "lengths", "people", "bins", "fit"])

    return materialize(state.select("cell", "island", "uids", "lengths", "people").mapInArrow(run, _STATE), "islands")


def _round(items: DataFrame, capacity: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """uid, length, sequence_id, offset, fill: each cell's best packing over its islands."""
    cells = _cells(items)
    given = F.when(F.length("given") > 0, F.array("given")).otherwise(F.array().cast("array<binary>"))
    state = cells.withColumn("people", given).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = _epoch(state, 0, capacity, generations, population)
    for epoch in range(1, epochs):
        elite = state.select("cell", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("people")[0].alias("elite"))
        own = F.slice("people", 1, population - 1)
        state = _epoch(state.join(elite, ["cell", "island"]).withColumn("people", F.concat(own, F.array("elite"))), epoch, capacity, generations, population)
    best = state.groupBy("cell").agg(F.min(F.struct("bins", (-F.col("fit")).alias("unfit"), "island")).alias("best")).select("cell", F.col("best.island").alias("island"))
    chosen = state.join(best, ["cell", "island"]).select("uids", "lengths", F.col("people")[0].alias("bins"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                uids, lengths, bins = (np.frombuffer(c[r].as_py(), t) for c, t in zip(batch.columns, (np.int64, np.int32, np.int32), strict=True))
                order = np.lexsort((uids, bins))
                uids, lengths, bins = uids[order], lengths[order].astype(np.int64), bins[order]
                first = np.concatenate(([True], bins[1:] != bins[:-1]))
                begin = np.flatnonzero(first)
                which = np.cumsum(first) - 1
                ends = np.cumsum(lengths)
                offset = ends - lengths
                offset = offset - offset[begin][which]
                fill = np.bincount(which, weights=lengths).astype(np.int64)[which]
                yield pa.RecordBatch.from_arrays([pa.array(uids), pa.array(lengths), pa.array(uids[begin][which]), pa.array(offset), pa.array(fill)],
                                                 ["uid", "length", "sequence_id", "offset", "fill"])

    return materialize(chosen.mapInArrow(spread, "uid long, length long, sequence_id long, offset long, fill long"), "packed")


def pack(parts: DataFrame, capacity: int = CAPACITY, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS,
         generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """sequence_id and offset for every piece; sequence_id is the smallest uid of its sequence."""
    whole = parts.filter(F.col("length") >= capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = parts.filter(F.col("length") < capacity).select("uid", "length", F.lit(None).cast("long").alias("bin"))
    done, before = [whole], None
    while n := items.count():
        cells = -(-n // cell)
        key = F.xxhash64(F.coalesce("bin", "uid"))
        packed = _round(items.withColumn("cell", F.pmod(key, F.lit(cells))), capacity, islands, epochs, generations, population)
        loose = F.col("fill") < int(OPEN * capacity)
        sequences = packed.filter(loose).select("sequence_id").distinct().count()
        if cells == 1 or sequences < 2 or before == sequences:
            done.append(packed.select("uid", "sequence_id", "offset"))
            break
        before = sequences
        done.append(packed.filter(~loose).select("uid", "sequence_id", "offset"))
        items = packed.filter(loose).select("uid", "length", F.col("sequence_id").alias("bin"))
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    return parts.join(placed, "uid")


def pack_documents(docs: DataFrame, tokenizer: str, **limits: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    capacity = limits.get("capacity", CAPACITY)
    return pack(pieces(docs, tokenizer, capacity), **limits).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
