from __future__ import annotations

import hashlib
import math
import re
import struct

from pyspark.sql import functions as F

from ledgerloom.functions import vectors as V


def _single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def _plain(text):
    if text is None:
        return None
    counts = [0] * 64
    for word in re.findall(r"\w+", text.lower()):
        mark = hashlib.md5(word.encode()).digest()[0] % 128
        counts[mark % 64] += 1 if mark < 64 else -1
    norm = math.sqrt(sum(x * x for x in counts))
    return [_single(x / norm) for x in counts] if norm else []


def _cancelling():
    """Two words that meet in one slot with different signs."""
    seen = {}
    for i in range(2000):
        mark = hashlib.md5(f"w{i}".encode()).digest()[0] % 128
        if (mark + 64) % 128 in seen:
            return f"w{i} {seen[(mark + 64) % 128]}"
        seen[mark] = f"w{i}"


def test_embedding_equals_a_plain_count(spark):
    texts = ["a", "", None, "The quick brown fox, the FOX", "Été ÀÉ 12_x 数据", "- !", "x " * 5000, _cancelling(), " ".join(f"w{i}" for i in range(3000))]
    V.register(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = df.select("i", V.embed_fn("text").alias("v"), F.expr("embed_text(text)").alias("by_sql")).orderBy("i").collect()
    assert [r.v for r in got] == [_plain(t) for t in texts] == [r.by_sql for r in got]
    assert got[7].v == [] and got[2].v is None


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a",)], "text string").select(V.embed_fn("text"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
