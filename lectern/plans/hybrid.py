"""Retrieval plans: words, vectors and their fusion for all questions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from lectern.operators.bm25 import bm25_topk
from lectern.operators.evaluation import label_sources, recall_mrr
from lectern.operators.fusion import rrf
from lectern.operators.vectors import vector_topk

DEPTH = 10


def hybrid(corpus: DataFrame, questions: DataFrame, rows: DataFrame, vectors: DataFrame, depth: int = DEPTH, where: Column | str | None = None) -> dict[str, DataFrame]:
    """Rankings (qid, id, score, rank) named words, vector and hybrid.

    ``corpus`` (id, text) and ``rows`` (id, vector) hold the passages, ``questions`` (qid, text) and ``vectors``
    (qid, vector) what is asked; ``where`` filters both before anything is ranked.  The two rankings by words and by
    vectors, ``depth`` rows a question, are persisted, as the third is read from them.
    """
    words = bm25_topk(corpus if where is None else corpus.where(where), questions, depth).persist()
    near = vector_topk(rows, vectors, depth, where).persist()
    return {"words": words, "vector": near, "hybrid": rrf({"words": words, "vector": near}, depth=depth)}


def evaluate(rankings: dict[str, DataFrame], correct: DataFrame, questions: DataFrame) -> DataFrame:
    """Recall at k and MRR of each ranking, one row a source."""
    return recall_mrr(label_sources(rankings), correct, questions, sources=list(rankings))
