from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import catalog, chat
from tests.llm.conftest import SF

TURNS = "conv_id long, turn long, role string, text string, segment string, seq int"


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _expected(rows):
    by = {}
    low = lambda x: (x is not None, x)
    for c, t, r, x, *_ in sorted(rows, key=lambda a: (low(a[0]), low(a[1]), a[2] or "", a[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), _sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), _sha(loss), sum(r == "assistant" for r, _ in turns))
    return out


def _got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.n_examples) for r in df.collect()}


def test_round_trip_of_odd_turns(spark):
    rows = [(1, 0, "user", "hi", "a", 1), (1, 1, "assistant", "<|end|>\n<|start|>x\\<|message|>", "a", 1), (1, 2, "assistant", "", "a", 1),
            (2, 0, None, None, "a", 1), (2, None, "assistant", "\\\\</s>[INST]é𝄞", None, None), (None, 0, "us\ner<|end|>", "t\r\n", "b", 2),
            (3, 5, "assistant", "same", "b", 2), (3, 5, "assistant", "same", "b", 2), (4, 0, "user", "only a question", "b", 2),
            (5, 0, "assistant", "long " * 50000, "b", 2)]
    df = chat.render(spark.createDataFrame(rows, TURNS))
    assert _got(chat.read_back(df)) == _expected(rows)
    for r in df.collect():
        assert all(c not in r.segment.removeprefix(chat.START)[:-1].removesuffix(chat.END).replace(chat.MESSAGE, "", 1) for c in chat.CONTROL)


def test_examples_are_prefixes(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}", "", 0) for i in range(7)]
    df = chat.render(spark.createDataFrame(rows, TURNS))
    whole = "".join(r.segment for r in df.orderBy("seq").collect())
    found = chat.example_texts(df).orderBy("example").collect()
    assert [r.example for r in found] == [1, 2, 3]
    for n, r in enumerate(found):
        assert whole.startswith(r.text) and r.text[r.loss_start:r.loss_end] == f"t{2 * n + 1}"
    ends = {r.example: r.context_end for r in df.collect() if r.example}
    assert ends[1] == len(whole[:whole.index("<|start|>assistant")])


def test_empty(spark):
    assert chat.read_back(chat.render(spark.createDataFrame([], TURNS))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    assert _got(catalog.op1_chat_formatting(spark, SF)) == _expected([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_read_back_takes_examples_with_their_contexts(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}", "", 0) for i in range(7)]
    df = chat.render(spark.createDataFrame(rows, TURNS)).persist()
    made = chat.expanded(df).where("is_turn = 0").orderBy("example").collect()
    for e, t in zip(made, chat.example_texts(df).orderBy("example").collect(), strict=True):
        assert t.text[:e.context_end] + e.segment == t.text and (e.loss_start, e.loss_end) == (t.loss_start, t.loss_end)
    # Another context of the same length is not the context of the examples.
    other = df.withColumn("segment", F.replace("segment", F.lit("t0"), F.lit("x0")))
    with pytest.raises(Exception, match="does not follow"):
        chat.read_back(other).collect()


def test_every_example_is_written_out_whole(spark):
    rows = [(c, i, "assistant" if i % 3 else "user", f"t{c}-{i} <|end|>\n<|start|>\\", "", 0) for c in (None, 1, 2) for i in range(40)]
    rows += [(3, i, "assistant", "long " * 300_000, "", 0) for i in range(4)]
    df = chat.render(spark.createDataFrame(rows, TURNS))
    made = chat.written(df)
    key = lambda r: (r.conv_id or 0, r.example)
    got = sorted(((r.conv_id or 0, r.example, r.text, r.loss_start, r.loss_end) for r in made.where("is_turn = 0").collect()))
    assert got == [(*key(r), r.text, r.loss_start, r.loss_end) for r in sorted(chat.example_texts(df).collect(), key=key)] and len(got) == 3 * 26 + 4
    assert _got(chat.read_back(df)) == _expected(rows)


def test_only_a_null_conversation(spark):
    rows = [(None, 0, "user", "a", "", 0), (None, 1, "assistant", "b", "", 0)]
    assert _got(chat.read_back(chat.render(spark.createDataFrame(rows, TURNS)))) == _expected(rows)
