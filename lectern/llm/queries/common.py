"""What the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A document is called toxic, or good, from this score on.
THRESHOLD = 0.3


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
