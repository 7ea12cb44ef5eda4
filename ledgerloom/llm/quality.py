"""Text quality by a sparse rule ensemble.

Statistics of the whole text are taken in one pass (`statistics`); none of them looks at labels,
language, source or id.  Shallow boosted trees over the statistics of labelled documents give rules:
every path from a root is a conjunction of thresholds.  A logistic model with an L1 penalty on rules
and scaled statistics keeps few of them, and `score` compiles the kept ones into one Spark column
expression, which is what scores the corpus.

Training takes the labelled documents with the smallest hash of their ids, at most SAMPLE rows: about
twenty numbers each, fitted on the driver with a fixed seed.  Only documents whose
crc32(doc_id as text) mod 3 is not 1 are used.

Defined results: a null or empty text has zero statistics and a score like any other; several labels
of a document count as their maximum, null labels are left out; labels of one kind only, or none, give
a score of their smoothed share (0.5 without labels) everywhere; repeated rows are scored each; an
empty table gives no rows; further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.names import fresh

SAMPLE = 20_000
TREES = 24
DEPTH = 3
CUTS = 24
PENALTY = 2e-3
STATISTICS = ("log_bytes", "log_words", "word_bytes", "long_words", "short_words", "distinct_words", "top_word", "upper", "digits", "symbols",
              "repeated_symbols", "exclaims", "commas_stops", "spaces", "wide", "lines", "line_bytes", "distinct_lines", "symbol_ended_words", "run_bytes")
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+/<=>@\\^_`|~{}[]", b"!?", b",.;:", b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 7
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def measure(text: bytes) -> list[float]:
    """The statistics of one text."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text, np.uint8)
    kinds = _CLASS[raw]
    share = np.bincount(kinds, minlength=8) / n
    same = raw[1:] == raw[:-1]
    words = text.translate(_LOWER).split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    tally: dict[bytes, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    # The byte before each blank, and the last one, end a word.
    blank = kinds == 6
    ends = kinds[:-1][blank[1:] & ~blank[:-1]]
    ended = np.isin(ends, (3, 4)).sum() + int(kinds[-1] in (3, 4))
    symbol = (kinds == 3) | (kinds == 4)
    return [float(np.log1p(n)), float(np.log1p(len(words))), float(sizes.sum() / w), float((sizes > 14).sum() / w), float((sizes < 3).sum() / w),
            len(tally) / w, max(tally.values(), default=0) / w, share[1], share[2], share[3],
            float((same & symbol[1:]).sum() / n), share[4], share[5], share[6], share[7], float(np.log1p(len(lines))),
            float(np.log1p(n / max(1, len(lines)))), len(set(lines)) / max(1, len(lines)), float(ended / w), float(same.sum() / n)]


def statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """docs with the statistics of text as an array of doubles."""
    given = [f.name for f in docs.schema.fields if f.name != out]
    where = given.index(text)
    schema = T.StructType([docs.schema[c] for c in given] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).cast(pa.binary())
            stats = [measure(texts[i].as_py() or b"") for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stats, pa.list_(pa.float64()))], [*given, out])

    return docs.select(*given).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most sample documents that are not held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most sample rows of two numbers: small enough to send to every task, so that no text is shuffled.
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")).select("doc_id", "stats", "label")
    # A document that stands in many rows is one example.
    rows = rows.groupBy("doc_id").agg(F.min("stats").alias("stats"), F.max("label").alias("label")).toPandas().sort_values("doc_id")
    x = np.array(rows["stats"].tolist(), float).reshape(len(rows), len(STATISTICS))
    return x, (rows["label"].to_numpy(float) > 0.5).astype(float)


def _tree(bins: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, path: tuple, depth: int, rules: list, value: np.ndarray) -> None:
    """Grow a tree by second-order gain; every path below the root becomes a rule."""
    best = (1e-6, None)
    g, h = slope[rows].sum(), curve[rows].sum()
    if depth and len(rows) > 20:
        for f in range(bins.shape[1]):
            if not len(cuts[f]):
                continue
            left_g = np.cumsum(np.bincount(bins[rows, f], slope[rows], len(cuts[f]) + 1))[:-1]
            left_h = np.cumsum(np.bincount(bins[rows, f], curve[rows], len(cuts[f]) + 1))[:-1]
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g * g / (h + 1)
            gain[(left_h < 1) | (h - left_h < 1)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], (f, at))
    if path:
        rules.append(path)
    if best[1] is None:
        value[rows] = g / (h + 1)
        return
    f, at = best[1]
    low = bins[rows, f] <= at
    for side, part in ((True, rows[low]), (False, rows[~low])):
        _tree(bins, cuts, slope, curve, part, (*path, (f, float(cuts[f][at]), side)), depth - 1, rules, value)


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, cut, low in rule:
        out &= (x[:, f] <= cut) if low else (x[:, f] > cut)
    return out


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[tuple]:
    """Different paths of boosted trees, each grown on a random half of the rows and of the statistics."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 2)[1:-1])) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    margin, rules = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        some = rng.random(x.shape[1]) < 0.5
        value, grown = np.zeros(len(y)), []
        _tree(bins, [c if s else c[:0] for c, s in zip(cuts, some, strict=True)], y - p, p * (1 - p), rows, (), depth, grown, value)
        rules += grown
        margin[rows] += 0.3 * value[rows]
    return list(dict.fromkeys(rules))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> dict:
    """Intercept, scaled statistics and rules with weights that are not zero."""
    prior = (y.sum() + 1) / (len(y) + 2)
    model = {"intercept": float(np.log(prior / (1 - prior))), "linear": [], "rules": []}
    if not 0 < y.sum() < len(y):
        return model
    rules = extract_rules(x, y)
    held = np.stack([_holds(x, r) for r in rules], axis=1).astype(float) if rules else np.zeros((len(x), 0))
    low, high = np.quantile(x, [0.025, 0.975], axis=0)
    width = np.where(high > low, high - low, 1)
    design = np.hstack([(np.clip(x, low, high) - low) / width, held])
    # Accelerated proximal gradient for mean logistic loss plus penalty times the sum of absolute weights.
    step = 4 / (np.linalg.norm(design, 2) ** 2 / len(y) + 1)
    w, b, v, c, t = np.zeros(design.shape[1]), model["intercept"], np.zeros(design.shape[1]), model["intercept"], 1.0
    for _ in range(steps):
        off = (1 / (1 + np.exp(-np.clip(design @ v + c, -40, 40))) - y) / len(y)
        nw = v - step * (design.T @ off)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = c - step * off.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    k = x.shape[1]
    model["intercept"] = float(b)
    model["linear"] = [(f, float(low[f]), float(high[f]), float(w[f] / width[f])) for f in range(k) if w[f]]
    model["rules"] = [(r, float(weight)) for r, weight in zip(rules, w[k:], strict=True) if weight]
    return model


def score(model: dict, stats: str = "stats") -> Column:
    """The model as one column expression over the statistics."""
    at = lambda f: F.get(F.col(stats), F.lit(f))
    total = F.lit(model["intercept"])
    for f, low, high, weight in model["linear"]:
        total = total + (F.greatest(F.lit(low), F.least(F.lit(high), at(f))) - F.lit(low)) * F.lit(weight)
    for rule, weight in model["rules"]:
        holds = F.lit(True)
        for f, cut, low in rule:
            holds = holds & ((at(f) <= F.lit(cut)) if low else (at(f) > F.lit(cut)))
        total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> dict:
    return fit(*training_rows(docs, labels, label, sample))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, out: str = "score") -> DataFrame:
    """docs with a score (0 to 1: how likely the label is 1), which replaces a column of that name."""
    stats = fresh(docs, "_stats")
    return statistics(docs, out=stats).withColumn(out, score(train(docs, labels, label, sample), stats)).drop(stats)
