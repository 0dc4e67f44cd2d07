"""Toxicity of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import toxicity
from lectern.llm.queries.common import THRESHOLD, documents
from lectern.llm.runtime import crc_fold


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", crc_fold(F.col("doc_id"), 4) == 2)
    lexicon = toxicity.fit(docs.where(~F.col("held_out")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, lexicon, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits", "density")


query = op1_toxicity
SQL = None
