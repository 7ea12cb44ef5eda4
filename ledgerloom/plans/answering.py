"""A table of questions to evidence, context, prompt and confidence rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.vectors import embed_fn
from ledgerloom.operators import context as X
from ledgerloom.operators import retrieval as R
from ledgerloom.session import materialize


@dataclass
class Answered:
    questions: DataFrame
    hits: DataFrame
    citations: DataFrame
    contexts: DataFrame
    top_k: int

    def records(self) -> DataFrame:
        return X.answer_record(self.questions, self.hits, self.citations, self.top_k)

    def prompts(self, templates: DataFrame) -> DataFrame:
        return X.prompt_text(self.questions.join(self.contexts, "query_id", "left"), templates)


def answer_questions(questions: DataFrame, vectors: DataFrame, top_k: int = 10, embed=embed_fn, min_score: float = 0.0) -> Answered:
    """Classify, expand, embed, retrieve and pack the context of every question.

    ``questions``: query_id, question and any filter columns.
    """
    q = questions.withColumns({"question_type": X.classify_question("question"), "query_used": X.expand_query("question")})
    asked = q.withColumn("query_vector", embed(F.col("query_used")))
    # Read by citations, counts and confidence, hence written once; at most top_k rows per question, without their texts.
    hits = materialize(R.retrieve(asked.where(F.size("query_vector") > 0), vectors, top_k, min_score, texts=False), "answers")
    citations = X.context_blocks(R.with_text(hits, vectors))
    return Answered(q, hits, citations, X.build_context(citations), top_k)
