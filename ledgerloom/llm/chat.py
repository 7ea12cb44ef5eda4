"""Chat formatting with prefix-target expansion.

A conversation is rendered turn by turn as

    <|start|>role<|message|>text<|end|>\\n

and every assistant turn becomes an example of its own: all turns before it are context, and only that
reply's text is trainable.  The example of a turn is therefore exactly the rendered conversation up to
and including that turn.  It is shuffled as such: `render` gives each turn's segment once, with its
place in the conversation's stream, and an assistant turn also has its example number, the end of its
context, a digest of that context and its loss span.  `expanded` makes an example of every such turn:
its context, by reference, and its target.  `written` resolves the references against the stream (length and
digest must agree) and writes every example out, context included.  `read_back` reads the stream and the whole
examples, finds each context's digest equal to that of the turns before it and takes the trained text from the
example.  The examples of a conversation grow with the square of its turns; they pass from task to task's reader
in batches of bounded size and are neither shuffled nor stored.  `example_texts` makes the same table by columns.

Control strings inside roles and texts are escaped: a backslash is doubled and each control string
gets a backslash behind its first character, so that no control string is left.  `unescape` drops the
first backslash of each pair and is exact.  Strings of other common templates are escaped as well.

Turns are ordered by turn, then role and text, nulls first.  One shuffle by conversation puts them in
order; the running offset and the digests are streamed, so a very long conversation takes no more
memory than a short one.

Defined results: null text or role is empty; repeated turns are kept as turns of their own; turns
with a null conv_id are one conversation; an empty table gives no rows; a conversation without an
assistant turn has no example and an empty loss; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
# Control strings of this template and of others in common use.
CONTROL = (START, MESSAGE, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED = "assistant"
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MESSAGE) + "(.*?)" + re.escape(END) + "\n", re.S)
# Spark's hash functions start from this seed.
SEED = 42
# Characters of texts in a batch of written rows; a longer text is a batch of its own.
BATCH_CHARS = 4_000_000
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    """Reversibly break every control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: DataFrame) -> DataFrame:
    """conv_id, seq, role, segment, start, end; for assistant turns also example, context_end, context_digest, loss_start, loss_end.

    Places are code points of the conversation's stream, ends exclusive.  The digest of a context is the sum over
    its turns of the hash of segment and end.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).repartition("conv_id")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    trained = F.col("role") == TRAINED
    rows = rows.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(MESSAGE))).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    rows = rows.withColumns({"seq": F.row_number().over(order), "end": F.sum(F.length("segment").cast("long")).over(upto),
                             "n": F.sum(trained.cast("long")).over(upto)})
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("context_digest", F.coalesce(F.sum(F.xxhash64("segment", "end").cast("decimal(38,0)")).over(before).cast("string"), F.lit("0")))
    start = F.col("end") - F.length("segment")
    return rows.select(
        "conv_id", "seq", "role", "segment", start.alias("start"), "end",
        F.when(trained, F.col("n")).alias("example"), F.when(trained, start).alias("context_end"), F.when(trained, F.col("context_digest")).alias("context_digest"),
        F.when(trained, start + F.length("head")).alias("loss_start"),
        F.when(trained, start + F.length("head") + F.length("body")).alias("loss_end"))


def example_texts(rendered: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end: every example written out, context included."""
    before = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = rendered.withColumn("text", F.array_join(F.collect_list("segment").over(before), ""))
    return whole.filter(F.col("example").isNotNull()).select("conv_id", "example", "text", "loss_start", "loss_end")


def expanded(rendered: DataFrame) -> DataFrame:
    """The stream's turns, and before each assistant turn its example: segment is then its target, after a context given by end and digest."""
    kinds = F.when(F.col("example").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    rows = rendered.withColumn("is_turn", F.explode(kinds))
    own = lambda c: F.when(F.col("is_turn") == 0, F.col(c)).alias(c)
    return rows.select("conv_id", "seq", "is_turn", "segment", *[own(c) for c in ("example", "context_end", "context_digest", "loss_start", "loss_end")])


def hashed(segment: str, end: int) -> int:
    """Spark's hash of a segment and its end, as a signed long."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", end), xxhash.xxh64_intdigest(segment.encode(), SEED))
    return h - (1 << 64) if h >> 63 else h


def written(rendered: DataFrame) -> DataFrame:
    """conv_id, is_turn, text, example, loss_start, loss_end: the stream's turns, and before each assistant turn its whole example.

    The rows of a conversation stay in order.  A task holds one conversation's stream and a batch.
    """
    kind = rendered.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "is_turn", "text", "example", "loss_start", "loss_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, begun, current = [], 0, False, None
        stream, digest, n = "", 0, 0
        for batch in batches:
            types = [batch.column(0).type, pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            for conv, is_turn, segment, number, context_end, of_context, first, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not begun or conv != current:
                    begun, current, stream, digest, n = True, conv, "", 0, 0
                if is_turn:
                    stream += segment
                    digest += hashed(segment, len(stream))
                    text = segment
                else:
                    n += 1
                    if (number, context_end, int(of_context)) != (n, len(stream), digest):
                        raise ValueError(f"example {number} of conversation {conv} does not follow the turns before it")
                    text = stream + segment
                rows.append((conv, is_turn, text, number, first, last))
                held += len(text)
                if held >= BATCH_CHARS:
                    yield out(rows, types)
                    rows, held = [], 0
            if rows:
                yield out(rows, types)
                rows, held = [], 0

    def out(rows, types):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    ordered = expanded(rendered).sortWithinPartitions("conv_id", "seq", "is_turn")
    ordered = ordered.select("conv_id", "is_turn", "segment", "example", "context_end", "context_digest", "loss_start", "loss_end")
    return ordered.mapInArrow(run, f"conv_id {kind}, is_turn int, text string, example long, loss_start long, loss_end long")


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse stream and written examples again: per conversation its turns, digests and the text its examples train on."""
    kind = rendered.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, current, state, stream = [], None, None, None
        for batch in batches:
            types = [batch.column(0).type, *[pa.string() if "sha256" in n else pa.int64() for n in names[1:]]]
            for conv, is_turn, text, number, first, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append(close(current, state))
                    current, state, stream = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], hashlib.sha256()
                if is_turn:
                    found = _TURN.fullmatch(text)
                    state[0] += 1
                    state[1].update(f"{unescape(found[1])}\n{unescape(found[2])}\n".encode())
                    state[4] += len(text)
                    stream.update(text.encode())
                    continue
                state[5] += 1
                # Control strings are escaped inside texts, so the last one that starts a turn starts the target.
                target = text.rfind(START)
                role = unescape(_TURN.fullmatch(text, target)[1])
                if (number, target, role) != (state[5], state[4], TRAINED) or hashlib.sha256(text[:target].encode()).digest() != stream.digest():
                    raise ValueError(f"example {number} of conversation {conv} does not follow the turns before it")
                reply = unescape(text[first:last])
                state[2] += len(reply)
                state[3].update(reply.encode())
            if done:
                yield out(done, types)
                done = []
        if state is not None:
            yield out([close(current, state)], types)

    def close(conv, s):
        return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5]

    def out(rows, types):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    return written(rendered).mapInArrow(run, schema)
