"""Test items found in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.decontaminate import find_leaks
from lectern.llm.queries.common import documents


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


query = op7_decontamination
SQL = None
