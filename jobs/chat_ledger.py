"""Daily ledger of a chat service: what its guards let through, whom they stopped, and what it cost.

    python -m jobs.chat_ledger --config jobs/chat_ledger.json --input /data/events --output /data/ledger --since 2024-03-01

The input is a Parquet table of messages (event_id, ts, user_id, props, value): time, chat, text and cost of each.  The guards
judge every message in the service's own order: rate limit, length, spending cap.  For each day and chat the ledger has the
messages by verdict, the cost of those that passed, and the chat's cost up to the end of that day; it is Parquet, partitioned
by day, in the time zone of the session.

Whether a message passes depends on what came before it, so every run judges the whole table; it writes the days from ``since``
to before ``until`` (all days by default), and only those, by dynamic partition overwrite.  The same input gives the same
partitions however often a day is written; a day that has lost all its messages keeps what it had.

A null user is a chat of its own; a null time is day null, and its messages come first; a null text has no length and a null
cost is 0; equal rows count as often as they are there.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line, load_config, seen
from lectern.operators.guards import WINDOW_SECONDS, guard_pipeline

log = logging.getLogger("chat_ledger")

LEDGER = "chat_id long, n_messages long, n_ok long, n_rate_limited long, n_too_long long, n_over_budget long, cost_usd double, cost_to_date double, day date"
VERDICTS = ("ok", "rate_limited", "too_long", "over_budget")


@dataclass(frozen=True)
class Config:
    input: str
    output: str
    limit: int
    longest: int
    cap: float
    window_seconds: float = WINDOW_SECONDS
    since: str | None = None
    until: str | None = None


def messages(events: DataFrame) -> DataFrame:
    """The table's rows as the guards take them; times that are null come before all others."""
    t = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.lit(float("-inf")))
    return events.select(F.col("user_id").cast("long").alias("chat_id"), F.col("event_id").cast("long").alias("seq"), t.alias("t"), F.col("props").cast("string").alias("text"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("cost_usd"))


def ledger(events: DataFrame, config: Config) -> DataFrame:
    """A row for each day and chat."""
    judged = guard_pipeline(messages(events), config.limit, config.longest, config.cap, config.window_seconds)
    day = F.when(F.col("t") > float("-inf"), F.to_date(F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))).alias("day")
    ok = F.col("verdict") == "ok"
    counts = [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in VERDICTS]
    days = judged.groupBy("chat_id", day).agg(F.count("*").alias("n_messages"), *counts, F.round(F.coalesce(F.sum(F.when(ok, F.col("cost_usd"))), F.lit(0.0)), 6).alias("cost_usd"))
    to_date = F.round(F.sum("cost_usd").over(Window.partitionBy("chat_id").orderBy(F.col("day").asc_nulls_first())), 6)
    return days.withColumn("cost_to_date", to_date).select("chat_id", "n_messages", *[f"n_{v}" for v in VERDICTS], "cost_usd", "cost_to_date", "day")


def run(spark: SparkSession, config: Config) -> None:
    read, written = Observation("chat_ledger read"), Observation("chat_ledger written")
    events = spark.read.parquet(config.input).select("event_id", "ts", "user_id", "props", "value").observe(read, F.count(F.lit(1)).alias("rows"))
    rows = ledger(events, config)
    if config.since is not None:
        rows = rows.where(F.col("day") >= F.lit(config.since).cast("date"))
    if config.until is not None:
        rows = rows.where(F.col("day") < F.lit(config.until).cast("date"))
    # a day's rows meet in as many files as its size asks for
    dealt = rows.hint("rebalance", "day").observe(written, F.count(F.lit(1)).alias("rows"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(config.output)
    log.info("read %d messages from %s, wrote %d rows to %s", seen(read), config.input, seen(written), config.output)


def read_output(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(output)


if __name__ == "__main__":
    command_line("chat_ledger", run, load_config(Config, sys.argv[1:], __doc__.split("\n")[0]))
