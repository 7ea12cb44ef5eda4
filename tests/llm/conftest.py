from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names clash with those the operators use."""
    def make(rows):
        full = [(i, t, "en", "src0", len(t or ""), 1, "x", "y", 0.5, 7, "z") for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", fp long, spans string, words string, score double, uid long, _body string").repartition(3)
    return make
