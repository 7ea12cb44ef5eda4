"""Exact removal of repeated byte strings over all documents, by suffix order.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document before, or
earlier in the same one.  The first occurrence of every string stays.

Cutting into groups.  Every window of LENGTH bytes belongs to its anchor, the GRAM bytes inside it
with the smallest hash (the leftmost of equals), which depends on the window's bytes alone.  So equal
windows have equal anchors at equal distances, and only windows with the same anchor are compared.
Windows one after the other with the same anchor are one segment: (hash of the anchor, hash of the
segment, document, place), 32 bytes for some 35 bytes of text, is all that is shuffled at first.
* Segments equal to an earlier one are repeated as a whole; this is what exact and near copies mostly
  consist of, however many there are.  Those that a task knows from its own texts are marked before
  the shuffle and dealt out evenly, so a line that stands everywhere sends one row per task and place.
* Segments whose anchor has no other content anywhere are unique.
* The others, the different contents around one anchor, are sorted as suffixes.

Suffix order.  What stands right of the anchor, and left of it backwards, is read in blocks of eight
bytes counted from the anchor; since all contents of an anchor are aligned there, equal bytes are
equal blocks.  The strings (anchor, blocks) of many anchors are sorted by one suffix array, built by
linear grouping (`suffixes`), and neighbours' common bytes are counted.  For a window with r bytes
left of its anchor, runs of right neighbours that agree in what the window has at the right, and of
left neighbours that agree in r bytes, number its content; the smallest (document, place) of each
number is the first occurrence, all others are removed.  No pairs are formed: the work for an anchor
with n contents is n log n.  An anchor with more than LIST contents, as a passage of 32 to 99 bytes in many documents
has, is not sorted in one task: its windows are dealt out by the hash of their bytes, and the first of each
stays; windows that a task knows from its own texts are marked before the shuffle.

Anchor and segment hashes have 64 bits each, and the windows compared byte by byte share the first.
Texts of one id are told apart by 63 bits of a hash.

Defined results: null text is empty; a text shorter than LENGTH stays; rows with the same id and
text are the same document and get the same result; rows with the same id and different texts are
documents of their own, in the order of a hash of the text; a null id comes before all others; an
empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.suffixes import suffix_array
from ledgerloom.session import materialize, release

LENGTH = 100
GRAM = 32
SIDE = LENGTH - GRAM  # bytes of a window outside its anchor
WINDOW = SIDE + 1  # anchors a window can have
BLOCKS = -(-SIDE // 8)
CHUNK = 1 << 18
SORTED_TOGETHER = 2048
LIST = 4096
NO_ID = -(1 << 63)
AGAIN = np.int64(-(1 << 63))
SEEN = 1 << 18
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashed strings one after the other."""
    h = a * _A
    h += b
    h *= _C
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 32 and of the 64 bytes from every place on; of 64, only where there are as many."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * _B
    h ^= h >> np.uint64(31)
    n = 1
    while n < GRAM:
        h = _join(h[:-n], h[n:])
        n *= 2
    return h, _join(h[:-n], h[n:]) if len(h) > n else h[:0]


def segments(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments over the window starts (ascending): anchor hash, segment hash, first start, anchor less last and less first start."""
    g32, g64 = grams(raw)
    keep = np.uint64(CHUNK * 2 - 1)
    best = (g32 & ~keep) | np.arange(len(g32), dtype=np.uint64)
    n = 1
    while 2 * n <= WINDOW:
        best = np.minimum(best[:-n], best[n:])
        n *= 2
    if WINDOW > n:
        best = np.minimum(best[:n - WINDOW], best[WINDOW - n:])
    anchor = (best[starts] & keep).astype(np.int64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    first, last = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))]
    anchor = anchor[np.concatenate(([0], cut))]
    size = last - first + LENGTH  # at most LENGTH + SIDE, which three strings of 64 cover
    whole = _join(_join(g64[first], g64[first + (size - 64) // 2]), g64[last + LENGTH - 64]) ^ size.astype(np.uint64)
    return g32[anchor], whole, first, anchor - last, anchor - first


def _pack(start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First window start, least and largest number of bytes left of the anchor in one long that sorts by start."""
    return (start << 14) | (high << 7) | low


def _anchor(packed: np.ndarray) -> np.ndarray:
    return (packed >> 14) + ((packed >> 7) & 127)


def _texts(docs: DataFrame) -> DataFrame:
    """doc, tag, text: the id, a hash that tells texts of one id apart and is negative for a null id, and the bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tag = F.xxhash64(text)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.when(F.col("doc_id").isNull(), tag.bitwiseOR(F.lit(NO_ID))).otherwise(tag.bitwiseAND(F.lit((1 << 63) - 1))).alias("tag"),
                       text.cast("binary").alias("text"))


def all_segments(texts: DataFrame) -> DataFrame:
    """key, seg, doc, tag, packed of every segment of every text; long texts are worked through in chunks.

    A negative packed is a segment that the task has met at an earlier place; its key is only there to deal it out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, {}
        for batch in batches:
            doc, tag, text = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for i in range(batch.num_rows):
                data = np.frombuffer(text[i].as_py(), np.uint8)
                for at in range(0, len(data) - LENGTH + 1, CHUNK):
                    part = data[at:at + CHUNK + LENGTH - 1]
                    held.append((doc[i], tag[i], at, part))
                    size += len(part)
                    if size >= CHUNK // 2:
                        yield cut(held, seen)
                        held, size = [], 0
        if held:
            yield cut(held, seen)

    def cut(parts: list, seen: dict) -> pa.RecordBatch:
        sizes = np.array([len(p[3]) for p in parts])
        begin = np.cumsum(sizes) - sizes
        starts = np.concatenate([np.arange(b, b + n - LENGTH + 1) for b, n in zip(begin, sizes, strict=True)])
        key, seg, first, low, high = segments(np.concatenate([p[3] for p in parts]), starts)
        which = np.searchsorted(begin, first, side="right") - 1
        doc, tag, at = (np.array([p[c] for p in parts], np.int64)[which] for c in range(3))
        packed = _pack(first - begin[which] + at, low, high)
        again = np.zeros(len(key), bool)
        for i, (k, s, place) in enumerate(zip(key.tolist(), seg.tolist(), zip(doc.tolist(), tag.tolist(), packed.tolist(), strict=True), strict=True)):
            known = seen.get(s)
            if known and known[0] == k and known[1] < place:
                again[i] = True
            else:
                seen[s] = (k, place)
        if len(seen) > SEEN:
            seen.clear()
        key, seg = np.where(again, _join(tag.view(np.uint64), packed.view(np.uint64)), key), np.where(again, np.uint64(0), seg)
        packed = np.where(again, packed | AGAIN, packed)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(doc), pa.array(tag), pa.array(packed)],
                                          ["key", "seg", "doc", "tag", "packed"])

    return texts.mapInArrow(run, "key long, seg long, doc long, tag long, packed long")


def sifted(found: DataFrame) -> DataFrame:
    """Repeats of equal segments (variant false) and first segments of anchors with several contents (variant true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            marked = rows[4] < 0
            if marked.any():
                repeats = rows[:, marked]
                repeats[4] &= ~AGAIN
                yield out(repeats, False)
                rows = rows[:, ~marked]
            if not rows.shape[1]:
                continue
            before = np.concatenate([rows[:, :1] - 1 if last is None else last, rows[:, :-1]], axis=1)
            equal = rows == before
            last = rows[:, -1:].copy()
            # The same place twice is a row that repeats a document.
            same, twice = equal[:2].all(axis=0), equal.all(axis=0)
            yield out(rows[:, same & ~twice], False)
            news = rows[:, ~same]
            news = news if held is None else np.concatenate([held, news], axis=1)
            edge = np.searchsorted(news[0], news[0, -1]) if news.shape[1] else 0
            whole, held = news[:, :edge], news[:, edge:]
            yield from several(whole)
        if held is not None:
            yield from several(held)

    def several(news: np.ndarray) -> Iterator[pa.RecordBatch]:
        if news.shape[1]:
            alike = news[0, 1:] == news[0, :-1]
            yield out(news[:, np.concatenate(([False], alike)) | np.concatenate((alike, [False]))], True)

    def out(rows: np.ndarray, variant: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(rows[i]) for i in (0, 2, 3, 4)), pa.array(np.full(rows.shape[1], variant))], ["key", "doc", "tag", "packed", "variant"])

    dealt = found.repartition("key").sortWithinPartitions("key", "seg", "doc", "tag", "packed")
    return dealt.mapInArrow(run, "key long, doc long, tag long, packed long, variant boolean")


def contexts(wanted: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """key, r, h, doc, tag, packed, context.

    For an anchor of at most limit contents, one row for each: r is -1, context has SIDE bytes right of the anchor, then
    left of it backwards, each filled up with zeros.  For any other, one row for each window: r of its bytes stand left
    of the anchor, h is their hash, context is null; a negative packed is a window that the task has met at an earlier place.
    """
    long = wanted.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("key", F.lit(True).alias("long"))
    asked = wanted.join(long, "key", "left").groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "packed", F.coalesce("long", F.lit(False)).alias("long"))).alias("asked"))
    names = ["key", "r", "h", "doc", "tag", "packed", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead, seen = np.arange(8 * BLOCKS), {}
        for batch in batches:
            for i in range(batch.num_rows):
                doc, tag, text, asked = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].values
                key, packed = (asked.field(c).to_numpy() for c in range(2))
                long = asked.field(2).to_numpy(zero_copy_only=False)
                if long.any():
                    yield from windows(doc, tag, text, key[long], packed[long], seen)
                    key, packed = key[~long], packed[~long]
                room = np.zeros(8 * BLOCKS, np.uint8)
                data = np.concatenate([room, np.frombuffer(text, np.uint8), room])
                for at in range(0, len(key), 4096):
                    k, p = key[at:at + 4096], packed[at:at + 4096]
                    anchor = _anchor(p) + 8 * BLOCKS
                    right, back = data[anchor[:, None] + GRAM + ahead], data[anchor[:, None] - 1 - ahead]
                    right[:, SIDE:], back[:, SIDE:] = 0, 0
                    both = np.concatenate([right, back], axis=1).tobytes()
                    step = 16 * BLOCKS
                    yield rows(k, np.full(len(k), -1), np.zeros(len(k), np.int64), doc, tag, p, pa.array([both[x:x + step] for x in range(0, len(both), step)], pa.binary()))

    def windows(doc: int, tag: int, text: bytes, key: np.ndarray, packed: np.ndarray, seen: dict) -> Iterator[pa.RecordBatch]:
        for k, p in zip(key.tolist(), packed.tolist(), strict=True):
            first, low, high = p >> 14, p & 127, (p >> 7) & 127
            r = np.arange(high, low - 1, -1)
            start = first + np.arange(len(r))
            h = np.array([xxhash.xxh64_intdigest(text[s:s + LENGTH]) for s in start.tolist()], np.uint64).view(np.int64)
            one = _pack(start, r, r)
            again = np.zeros(len(r), bool)
            for i, (at, content, place) in enumerate(zip(r.tolist(), h.tolist(), one.tolist(), strict=True)):
                if (before := seen.get((k, at, content))) and before < (doc, tag, place):
                    again[i] = True
                else:
                    seen[k, at, content] = (doc, tag, place)
            if len(seen) > SEEN:
                seen.clear()
            yield rows(np.full(len(r), k), r, np.where(again, one, h), doc, tag, np.where(again, one | AGAIN, one), pa.nulls(len(r), pa.binary()))

    def rows(key: np.ndarray, r: np.ndarray, h: np.ndarray, doc: int, tag: int, packed: np.ndarray, context: pa.Array) -> pa.RecordBatch:
        same = [np.full(len(key), v) for v in (doc, tag)]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(r, pa.int64()), pa.array(h), *map(pa.array, same), pa.array(packed), context], names)

    first = texts.dropDuplicates(["doc", "tag"])
    return asked.join(first, ["doc", "tag"]).select("doc", "tag", "text", "asked").mapInArrow(run, "key long, r long, h long, doc long, tag long, packed long, context binary")


def ordered(keys: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by key and bytes, from a suffix array over blocks, and the bytes each shares with the row before (-1: other key)."""
    n = len(keys)
    blocks = side.reshape(n, BLOCKS, 8).copy().view(">u8").reshape(n, BLOCKS)
    symbols = np.unique(blocks.astype(np.uint64), return_inverse=True)[1].reshape(n, BLOCKS) + 1
    head = np.unique(keys, return_inverse=True)[1] + int(symbols.max()) + 1
    text = np.concatenate([head[:, None], symbols, np.zeros((n, 1), np.int64)], axis=1)
    order = np.array(suffix_array(text.ravel().tolist()))
    order = order[order % (BLOCKS + 2) == 0] // (BLOCKS + 2)
    a, b = side[order[:-1]], side[order[1:]]
    differ = a != b
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), 8 * BLOCKS)
    common[keys[order[1:]] != keys[order[:-1]]] = -1
    return order, np.concatenate(([-1], common))


def repeated_windows(keys: np.ndarray, packed: np.ndarray, context: np.ndarray) -> np.ndarray:
    """rows x WINDOW: whether the window with r bytes left of the row's anchor starts earlier somewhere; rows are in document order."""
    n = len(keys)
    low, high = packed & 127, (packed >> 7) & 127
    right, r_common = ordered(keys, np.ascontiguousarray(context[:, :8 * BLOCKS]))
    left, l_common = ordered(keys, np.ascontiguousarray(context[:, 8 * BLOCKS:]))
    gone = np.zeros((n, WINDOW), bool)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for r in range(WINDOW):
        part = np.flatnonzero((low <= r) & (r <= high))
        if len(part) < 2:
            continue
        r_class[right] = np.cumsum(r_common < SIDE - r)
        l_class[left] = np.cumsum(l_common < r)
        content = r_class[part] * (n + 1) + l_class[part]
        _, first = np.unique(content, return_index=True)
        again = np.ones(len(part), bool)
        again[first] = False
        gone[part[again], r] = True
    return gone


def variant_ranges(known: DataFrame) -> DataFrame:
    """doc, tag, start, end: repeated bytes of the segments whose anchor has several contents."""
    places = ["key", "r", "h", "doc", "tag", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(6)])
            single = rows[1] >= 0
            if single.any():
                marked = rows[5] < 0
                own = rows[:, single & ~marked]
                before = np.concatenate([own[:, :1] - 1 if last is None else last, own[:, :-1]], axis=1)[:, :own.shape[1]]
                last = own[:, -1:].copy() if own.shape[1] else last
                repeats = np.concatenate([rows[:, marked], own[:, (own[:3] == before[:3]).all(axis=0) & ~(own == before).all(axis=0)]], axis=1)
                start = (repeats[5] & ~AGAIN) >> 14
                yield ranges(repeats[3], repeats[4], start, start + LENGTH)
            table = pa.table(batch.filter(pa.array(~single)))
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= SORTED_TOGETHER:
                key = held.column("key").to_numpy()
                edge = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                at = 0
                while at < edge:
                    # Whole keys, about SORTED_TOGETHER rows at a time.
                    to = min(at + SORTED_TOGETHER, edge)
                    to = edge if to == edge else int(np.searchsorted(key[:edge], key[to], side="left"))
                    to = to if to > at else int(np.searchsorted(key[:edge], key[at], side="right"))
                    yield work(held.slice(at, to - at))
                    at = to
                held = held.slice(edge)
        if held is not None and held.num_rows:
            yield work(held)

    def ranges(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, tag, start, end)], ["doc", "tag", "start", "end"])

    def work(rows: pa.Table) -> pa.RecordBatch:
        key, doc, tag, packed = (rows.column(c).to_numpy() for c in ("key", "doc", "tag", "packed"))
        context = np.frombuffer(b"".join(rows.column("context").to_pylist()), np.uint8).reshape(len(key), -1)
        order = np.lexsort((packed, tag, doc))
        key, doc, tag, packed, context = key[order], doc[order], tag[order], packed[order], context[order]
        gone = np.pad(repeated_windows(key, packed, context), ((0, 0), (1, 1)))
        row, from_r = np.nonzero(gone[:, 1:] & ~gone[:, :-1])
        to_r = np.nonzero(gone[:, 1:] & ~np.pad(gone[:, 2:], ((0, 0), (0, 1))))[1]
        anchor = _anchor(packed)
        return ranges(doc[row], tag[row], anchor[row] - to_r, anchor[row] - from_r + LENGTH)

    return known.select(*places, "context").repartition("key", "r", "h").sortWithinPartitions(*places).mapInArrow(run, "doc long, tag long, start long, end long")


def kept(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc, tag, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    per = ranges.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                doc, tag, text, gone = *(batch.column(c)[i].as_py() for c in range(3)), batch.column(3)[i]
                spans, left = [], text
                if gone.is_valid:
                    start, end = (gone.values.field(c).to_numpy() for c in range(2))
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    cut = np.flatnonzero(start[1:] > end[:-1]) + 1
                    spans = list(zip(start[np.concatenate(([0], cut))].tolist(), end[np.concatenate((cut - 1, [len(end) - 1]))].tolist(), strict=True))
                    at, parts = 0, []
                    for a, b in spans:
                        parts.append(text[at:a])
                        at = b
                    left = b"".join([*parts, text[at:]])
                rows.append((doc, tag, len(text), len(text) - len(left), len(spans), left))
                size += len(left)
                if size > 16 << 20:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        doc, tag, size, gone, spans, left = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
                                           pa.array(left, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in left])],
                                          ["doc", "tag", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return texts.join(per, ["doc", "tag"], "left").select("doc", "tag", "text", "gone").mapInArrow(
        run, "doc long, tag long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def remove_repeats(docs: DataFrame, limit: int = LIST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256 of every document."""
    texts = _texts(docs)
    repeats = materialize(sifted(all_segments(texts)), "repeats")
    packed = F.col("packed")
    start = F.shiftright(packed, 14)
    whole = repeats.filter(~F.col("variant")).select(
        "doc", "tag", start.alias("start"),
        (start + F.shiftright(packed, 7).bitwiseAND(F.lit(127)) - packed.bitwiseAND(F.lit(127)) + LENGTH).alias("end"))
    parts = variant_ranges(contexts(repeats.filter("variant").select("key", "doc", "tag", "packed"), texts, limit))
    ranges = materialize(whole.unionByName(parts), "ranges")
    release(repeats)
    done = kept(texts, ranges)
    return done.withColumn("doc_id", F.when(F.col("tag") >= 0, F.col("doc"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
