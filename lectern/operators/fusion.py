"""Reciprocal rank fusion of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.bm25 import ranked

RRF_K = 60


def rrf(rankings: dict[str, DataFrame], k: int = RRF_K, depth: int | None = None) -> DataFrame:
    """(qid, id, score, rank) from rankings (qid, id, rank); each counts down to ``depth``, the result is not cut."""
    rows = reduce(DataFrame.unionByName, [r.select("qid", "id", "rank") for r in rankings.values()])
    if depth is not None:
        rows = rows.where(F.col("rank") <= depth)
    return ranked(rows.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score")), by="score")
