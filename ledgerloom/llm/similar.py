"""Near-duplicates by the true similarity of their word shingles, found by SimHash and a byte-position inverted index.

Two texts are linked if their sets of WIDTH-word shingles have a Jaccard similarity of 0.8 or more.  The steps are
those of `simhash`, with numbers for that similarity: 64 bits and three differing ones cannot tell 0.8 from
less, so a fingerprint has POSITIONS bytes.  A bit is set if it is set in over half of the shingles' hashes; a tie falls
to the bit of the smallest hash, or small even sets would crowd the lists of low bytes.

Two sets of a similarity of 0.8 differ in a bit with a probability of 0.152 at most, so they share a positional
byte with one of 0.269.  The index has one posting for every two of three neighbouring positions, keyed by the
positions and their two bytes: 135 postings a text, whatever its length.  A pair of 0.8 has no key in common with a
probability of (0.731^3 + 3 * 0.269 * 0.731^2)^45 = 0.00015, a closer one with less.  Only four shingles against five differ
in more bits, 0.1875; so few have a posting for every two of nine positions.  Sets of less than four are linked to their copies only,
which are never missed.

A posting carries CHECKED bytes that are in no key.  Inside a key's list the members that differ in at most NEAR of their
bits are put together, all others are dropped: pairs never become rows, and lists of members that met by chance
end there.  What is left are lists of texts that may be similar.  In a pair of those the shared positional bytes are tallied and the
differing bits counted; pairs that share fewer than LEAST bytes, differ in more than DISTANCE bits or whose sizes allow no 0.8
cannot be links but for a probability of about one in 100,000; all others are verified on their whole sets, so no link is wrong.

Only different sets are posted, so copies cost nothing.  First every set is compared with TRIES others at most, of the first and last
members of its lists those that it meets most often, so a large group of near copies becomes one component by a number of pairs in
proportion to its members.  After that every member of a list is looked at once, however many lists it is in.  A similarity of 0.8 leaves room for one shingle in five without a partner, so two sets of it share one of the rarest
fifth (and one more) of each; before the first they share, no more than a ninth of both together may be left out.  Sets that this allows a link to
another component form clusters, dealt out in blocks of about BLOCK members, and each pair of blocks of a cluster is
one tile.  A tile counts the shingles that its members share by postings
of its own and gives only the links that join components, at most one for each member; pairs never
become rows.  No list is cut off.  The members of a list are in one task, some 32 bytes each.

Shingles and sets are told apart by 64-bit hashes.

Defined results: null, empty and blank texts have the empty set and are linked to each other only;
fewer words than a shingle are one shingle; ASCII letters count without case; repeated rows are
copies; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.components import components
from ledgerloom.llm.simhash import _LOWER, SEED
from ledgerloom.session import materialize, release

WIDTH = 5
WORDS = 19
POSITIONS = 8 * WORDS
CHECKED = 16
FEW = 15
NEAR = 40
LEAST = 9
DISTANCE = 290
LONG = 512
TRIES = 8
HELD = 64
BLOCK = 1024
_STEP = 1 << 14
_LANES = np.uint64(0x0101010101010101)
_OWN = np.random.default_rng(SEED).integers(0, 1 << 63, (WORDS, 1), dtype=np.uint64)
#: Two positions for each key; WIDE marks those that all sets have, the others are for sets of FEW shingles.
KEYS = np.array([(9 * g + a, 9 * g + b) for g in range(15) for a, b in combinations(range(9), 2)])
WIDE = KEYS[:, 0] // 3 == KEYS[:, 1] // 3


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Different hashes of the text's word shingles, ascending."""
    words = (text or b"").translate(_LOWER).split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, ends = np.concatenate(([0], ends[:-width] + 1)), ends[width - 1:]
    return np.unique(np.concatenate([np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i:i + _STEP].tolist(), ends[i:i + _STEP].tolist(), strict=True)], np.uint64)
                                     for i in range(0, len(starts), _STEP)]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each number's 64 bits stirred."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The POSITIONS bytes of the SimHash of a set of hashes; each hash gives WORDS words of its own."""
    ones, first = np.zeros((WORDS, 8, 8), np.int64), np.full(WORDS, np.iinfo(np.uint64).max)
    for i in range(0, len(found), 255):
        words = _mixed(found[None, i:i + 255] + _OWN)
        first = np.minimum(first, words.min(axis=1))
        for bit in range(8):  # eight counts of at most 255 in a word
            ones[:, :, bit] += ((words >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(WORDS, 8)
    # The smallest word's top bits are always unset, so what settles ties is that word stirred once more.
    tie = np.unpackbits(_mixed(first).view(np.uint8), bitorder="little").reshape(WORDS, 8, 8)
    return np.packbits(2 * ones + tie > max(len(found), 1), axis=2, bitorder="little").reshape(-1)


def described(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, key, node (hash of the set), size, print (its positional bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, prints = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32), []
            for i, text in enumerate(batch.column(2)):
                found = shingles(text.as_py())
                node[i], size[i] = xxhash.xxh64_intdigest(found.tobytes(), SEED), len(found)
                prints.append(fingerprint(found).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.view(np.int64)), pa.array(size), pa.array(prints, pa.binary())],
                                             ["doc_id", key, "node", "size", "print"])

    schema = T.StructType([docs.schema["doc_id"], docs.schema[key], T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()),
                           T.StructField("print", T.BinaryType())])
    return docs.select("doc_id", key, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def postings(prints: DataFrame) -> DataFrame:
    """h, node, x, y: one posting for each key of a set's print; h is the key's number and two bytes, x and y are the checked bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                node, few = part.column(0).to_numpy(), part.column(1).to_numpy() <= FEW
                found = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, POSITIONS)
                checked = found[:, -CHECKED:].copy().view(np.int64)
                for rows, own in ((~few, np.flatnonzero(WIDE)), (few, np.arange(len(KEYS)))):
                    if rows.any():
                        h = (own << 16) + (found[rows][:, KEYS[own, 0]].astype(np.int64) << 8) + found[rows][:, KEYS[own, 1]]
                        yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), *(pa.array(np.repeat(c[rows], len(own))) for c in (node, *checked.T))], ["h", "node", "x", "y"])

    return prints.select("node", "size", "print").filter("size >= 4").mapInArrow(run, "h long, node long, x long, y long")


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x[0] ^ y[0]) + np.bitwise_count(x[1] ^ y[1])


def _met(checked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (u, v) of a spanning forest of the members of one list that differ in at most NEAR checked bits."""
    left = np.arange(checked.shape[1])
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            grown, i = [], 0
            while i < len(front) and len(left):
                some = front[i:i + max(1, (1 << 20) // len(left))]
                i += len(some)
                near = _differing(checked[:, some, None], checked[:, None, left]) <= NEAR
                hit = near.any(axis=0)
                yield some[near[:, hit].argmax(axis=0)], left[hit]
                grown.append(left[hit])
                left = left[~hit]
            front = np.concatenate(grown)


def together(h: np.ndarray, node: np.ndarray, checked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """list, node: the members of each list h (equal ones adjoin) that differ little, directly or over others; the same members have the same list."""
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    length = np.diff(np.append(start, len(h)))
    behind = np.repeat(start + length, length) - np.arange(len(h)) - 1
    left, d, pairs = np.flatnonzero(np.repeat(length <= LONG, length)), 1, []
    while len(left := left[behind[left] >= d]):
        hit = left[_differing(checked[:, left], checked[:, left + d]) <= NEAR]
        pairs.append((hit, hit + d))
        d += 1
    for i in np.flatnonzero(length > LONG):
        pairs += [(u + start[i], v + start[i]) for u, v in _met(checked[:, start[i]:start[i] + length[i]])]
    u, v = (np.concatenate([p[i] for p in pairs] or [start[:0]]) for i in (0, 1))
    at, before = np.arange(len(h)), None
    while before is None or (at != before).any():
        before = at.copy()
        least = np.minimum(at[u], at[v])
        np.minimum.at(at, u, least)
        np.minimum.at(at, v, least)
        at = at[at]
    found = np.unique(np.concatenate([u, v]))
    name = np.zeros(len(h), np.uint64)
    np.add.at(name, at[found], _mixed(node[found].view(np.uint64)))
    return name[at[found]].view(np.int64), node[found]


def _ends(name: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The first and the last member, in the order of a hash, of each row's list."""
    order = np.lexsort((_mixed(node.view(np.uint64)), name))
    start = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1]))[:len(name)])
    length = np.diff(np.append(start, len(name)))
    ends = np.empty((2, len(name)), np.int64)
    ends[:, order] = np.repeat(np.stack([node[order[start]], node[order[start + length - 1]]]), length, axis=1)
    return ends


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The columns of sorted batches of whole numbers, cut where the first column changes."""
    rest = None
    for batch in batches:
        block = np.stack([c.to_numpy() for c in batch.columns])
        block = block if rest is None else np.concatenate([rest, block], axis=1)
        cut = np.searchsorted(block[0], block[0, -1]) if block.shape[1] else 0
        rest = block[:, cut:]
        yield block[:, :cut]
    if rest is not None:
        yield rest


def met(posted: DataFrame) -> DataFrame:
    """h, node, first, last: lists of sets that share a key of the index and differ little in their checked bytes, with two members of each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_lists(batches):
            if block.shape[1] > 1:
                name, node = together(block[0], block[1], block[2:].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (name, node, *_ends(name, node))], ["h", "node", "first", "last"])

    return posted.repartition("h").sortWithinPartitions("h").select("h", "node", "x", "y").mapInArrow(run, "h long, node long, first long, last long").distinct()


def _tries(lists: DataFrame) -> DataFrame:
    """Pairs (u, v): each set with those TRIES of its lists' first and last members (in the order of a hash) that stand beside it most often."""
    first, last = (lists.filter(F.col("node") != F.col(c)).select("node", F.col(c).alias("other")) for c in ("first", "last"))
    beside = first.unionByName(last).groupBy("node", "other").agg(F.count("*").alias("n"))
    best = beside.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "other"))).filter(F.col("rank") <= TRIES)
    return best.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def possible(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (u, v) that share LEAST positional bytes, differ in at most DISTANCE bits and have sizes that allow a similarity of 0.8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in (2, 3))
            near = ((x == y).sum(axis=1) >= LEAST) & (np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32) <= DISTANCE)
            yield batch.select([0, 1]).filter(pa.array(near))

    named = lambda n: prints.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("print").alias(f"{n}_print"))
    both = pairs.join(named("u"), "u").join(named("v"), "v").filter(5 * F.least("u_size", "v_size") >= 4 * F.greatest("u_size", "v_size"))
    return both.select("u", "v", "u_print", "v_print").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of 0.8 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in sets:
                if len(sets) == HELD:
                    sets.pop(next(iter(sets)))
                sets[node] = shingles(text.as_py())
            return sets[node]

        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            u, v = (batch.column(c).to_pylist() for c in (0, 1))
            for i in range(batch.num_rows):
                both = np.sort(np.concatenate([of(u[i], batch.column(2)[i]), of(v[i], batch.column(3)[i])]), kind="stable")
                hit[i] = 9 * np.count_nonzero(both[1:] == both[:-1]) >= 4 * len(both)
            yield batch.select([0, 1]).filter(pa.array(hit))

    named = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"{n}_text"))
    return pairs.join(named("u"), "u").join(named("v"), "v").select("u", "v", "u_text", "v_text").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, key, root: rows with the same root are connected by links; key tells rows apart that differ in id or text."""
    stored = materialize(described(docs, key), "shingled")
    lists = materialize(met(postings(stored.select("node", "size", "print").dropDuplicates(["node"]))), "lists")
    posted = materialize(lists.select("node").distinct(), "posted")
    prints = stored.select("node", "size", "print").join(posted, "node", "left_semi").dropDuplicates(["node"])

    tried = materialize(possible(_tries(lists), prints), "pairs")
    texts = _texts(docs, stored, tried.select(F.explode(F.array("u", "v")).alias("node")), key)
    links = materialize(verified(tried, texts), "similar")
    release(lists, tried, texts)

    roots = components(links).withColumnRenamed("u", "node")
    placed = materialize(posted.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    texts = _texts(docs, stored, placed.select("node"), key)
    sets = materialize(_sets(placed, texts), "sets")
    edges = materialize(_allowed(sets), "allowed")
    open_lists = materialize(_clusters(edges, placed), "clusters")
    more = materialize(_joining(open_lists, sets.select("node", "members")), "similar")
    release(posted, placed, texts, sets, edges, open_lists)

    last = components(links.unionByName(more)).withColumnRenamed("u", "node")
    release(links, more)
    return stored.join(last, "node", "left").select("doc_id", key, F.coalesce("root", "node").alias("root"))


def _sets(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, root, size, members: the whole sets, eight bytes a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = pa.array(shingles(batch.column(2)[i].as_py()).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns[:2]), pa.array([len(found)]), pa.ListArray.from_arrays([0, len(found)], found)], ["node", "root", "size", "members"])

    return nodes.join(texts, "node").select("node", "root", "text").mapInArrow(run, "node long, root long, size long, members array<long>")


def _allowed(sets: DataFrame) -> DataFrame:
    """u, v: each set that shares one of its rarest shingles with a set of another root, and may be similar to it, beside one of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _whole_lists(batches):
            kept = may_link(*block[[0, 2, 3, 4]])
            name, node = block[0, kept], block[1, kept]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(_ends(name, node)[0])], ["u", "v"])

    each, own = Window.partitionBy("s"), Window.partitionBy("node")
    every = sets.select("node", "root", "size", F.explode("members").alias("s"))
    shared = every.select("*", F.count("*").over(each).alias("n"), (F.min("root").over(each) != F.max("root").over(each)).alias("open")).filter("n > 1")
    # Shingles that no other set has come first.
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "s"))
    rare = shared.withColumn("place", place).filter("5 * (place - 1) <= size and open")
    return rare.repartition("s").sortWithinPartitions("s").select("s", "node", "root", "size", "place").mapInArrow(run, "u long, v long").filter("u <> v").distinct()


def may_link(s: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows that may be similar to a row of their list s (equal ones adjoin) and of another root, if s is the first shingle that both have in the order of places."""
    most = 9 * (size - place + 1) // 4 - size  # the largest set with which what is left suffices for 0.8
    most = np.minimum(most, 5 * size // 4)
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))[:len(s)])
    length = np.diff(np.append(start, len(s)))
    kept = np.zeros(len(s), bool)
    behind = np.repeat(start + length, length) - np.arange(len(s)) - 1
    left, d = np.flatnonzero(np.repeat(length <= LONG, length)), 1
    while len(left := left[behind[left] >= d]):
        hit = left[(root[left] != root[left + d]) & (size[left] <= most[left + d]) & (size[left + d] <= most[left])]
        kept[hit] = kept[hit + d] = True
        d += 1
    for i in np.flatnonzero(length > LONG):  # by sizes and roots alone, so that the work grows with the list
        rows = np.arange(start[i], start[i] + length[i])
        while len(rows):
            order = np.sort(size[rows])
            some = np.searchsorted(order, most[rows], "right") - np.searchsorted(order, -(-4 * size[rows] // 5)) > (size[rows] <= most[rows])
            if some.all():
                break
            rows = rows[some]
        kept[rows] = len(np.unique(root[rows])) > 1
    return kept


def _clusters(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """h, node, root, blocks: the sets by connected ones, and the number of blocks of each cluster."""
    placed = components(edges).select(F.col("root").alias("h"), F.col("u").alias("node")).join(nodes, "node")
    blocks = placed.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    return placed.join(blocks.select("h", "blocks"), "h")


def _joining(open_lists: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: links between members of different roots, a forest for each tile of each list."""
    block = F.pmod(F.xxhash64("node", "h"), F.col("blocks"))
    dealt = open_lists.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("h", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "root")
    given = dealt.join(sets, "node").repartition("h", "x", "y").sortWithinPartitions("h", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for i, (h, x, y, own, node, root) in enumerate(zip(*columns, strict=True)):
                if (h, x, y) != name:
                    yield from tile(held, name)
                    held, name = [], (h, x, y)
                held.append((own, node, root, batch.column(6)[i].values.to_numpy().copy()))
        yield from tile(held, name)

    def tile(held: list[tuple], name: tuple | None) -> Iterator[pa.RecordBatch]:
        if held:
            own, node, root, raw = zip(*held, strict=True)
            links = joining_links(list(raw), list(node), list(root), np.array(own) == name[1], np.array(own) == name[2])
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in links], pa.int64()) for i in (0, 1)], ["u", "v"])

    return given.select("h", "x", "y", "block", "node", "root", "members").mapInArrow(run, "u long, v long")


def joining_links(sets: list[np.ndarray], node: list[int], root: list[int], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs with a similarity of 0.8 or more of a left and a right member that join what is not yet connected."""
    parent = {r: r for r in root}

    def top(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    size = np.array([len(s) for s in sets])
    begin = np.cumsum(size) - size
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(shingle, kind="stable")]
    n = np.bincount(shingle)
    start = np.cumsum(n) - n
    out = []
    for i in np.flatnonzero(left):
        own = shingle[begin[i]:begin[i] + size[i]]
        own = own[n[own] > 1]
        lengths = n[own]
        ends = np.cumsum(lengths)
        shared = np.bincount(owner[np.repeat(start[own] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], minlength=len(sets))
        for j in np.flatnonzero((9 * shared >= 4 * (size[i] + size)) & right):
            a, b = top(root[i]), top(root[j])
            if a != b:
                parent[a] = b
                out.append((node[i], node[j]))
    return out


def _texts(docs: DataFrame, stored: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """node, text: one text for each of the sets."""
    asked = nodes.distinct()
    chosen = stored.select("node", key).join(asked, "node").groupBy("node").agg(F.min(key).alias(key))
    return materialize(docs.select(key, F.col("text").cast("binary").alias("text")).join(chosen, key).dropDuplicates(["node"]).select("node", "text"), "texts")
