"""JSON lines: readers with fixed schemas, writers, append logs and the tolerant spending journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.text import is_amount


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, broken ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """UTF-8 lines, in one folder a value of ``by`` if it is given."""
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(by) if by else writer).json(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows to a log that is read again to resume."""
    write(df, path, mode="append")


def read_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """(key, value) pairs of one JSON object in a file."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(config, qid, verdict) of a judge cache whose keys are ``config/qid``."""
    parts = F.split("key", "/", 2)
    return read_map(spark, path).select(F.get(parts, F.lit(0)).alias("config"), F.get(parts, F.lit(1)).alias("qid"), F.col("value").alias("verdict"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """(model, prompt, completion): prices a token from one JSON object of objects."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "map<string,struct<prompt:double,completion:double>>")).alias("model", "p"))
    return rows.select("model", "p.prompt", "p.completion")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(ts, chat_id, cost_usd) of a spending journal; corrupt, partial and blank lines and odd amounts are skipped."""
    return parse_journal(spark.read.text(path))


def parse_journal(lines: DataFrame) -> DataFrame:
    pick = lambda name: F.get_json_object("value", f"$.{name}")
    rows = lines.select(pick("ts").try_cast("timestamp").alias("ts"), pick("chat_id").try_cast("bigint").alias("chat_id"), pick("cost_usd").try_cast("double").alias("cost_usd"))
    return rows.where(is_amount(F.col("cost_usd")))


def total_spend(journal: DataFrame) -> DataFrame:
    return journal.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total"))
