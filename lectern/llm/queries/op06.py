"""Language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.lm import score_texts
from lectern.llm.queries.common import documents
from lectern.llm.runtime import crc_fold


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir).select("doc_id", "text"), crc_fold(F.col("doc_id"), 10) == 0)


query = op6_lm_scores
SQL = None
