"""Language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import langid
from lectern.llm.queries.common import documents
from lectern.llm.runtime import crc_fold


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", crc_fold(F.col("doc_id"), 4) == 2)
    profiles = langid.fit_profiles(docs.where(~F.col("held_out")))
    return langid.identify(docs, profiles, ["doc_id", "held_out"])


query = op4_language_id
SQL = None
