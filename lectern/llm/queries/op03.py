"""Quality of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import quality
from lectern.llm.queries.common import THRESHOLD, documents
from lectern.llm.runtime import crc_fold


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", crc_fold(F.col("doc_id"), 5) == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    trusted = docs.where(~F.col("held_out")).join(labels, "doc_id", "left_semi")
    model = quality.fit(trusted, docs)
    scored = quality.score(docs, model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


query = op3_quality
SQL = None
