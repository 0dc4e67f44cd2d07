"""Guards of a chat service in batch form: rate limit, length, spending cap, and their order."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from lectern.shared import cut

WINDOW_SECONDS = 60.0


def rate_limit(events: DataFrame, limit: int, window: float = WINDOW_SECONDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chat_id, seq, t), the columns to ``keep`` and accepted: at most ``limit`` accepted events within ``window`` seconds.

    Whether an event counts depends on earlier answers, so each chat is read in order as a stream of its partition; a
    chat's state is its accepted times within the window, at most ``limit`` of them, however long its history is.
    """
    rows = events.select("chat_id", "seq", "t", *keep)
    schema = StructType([*rows.schema.fields, StructField("accepted", BooleanType())])

    def run(batches):
        chat, times = object(), deque()
        for batch in batches:
            accepted = []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if c != chat:
                    chat, times = c, deque()
                while times and t - times[0] >= window:
                    times.popleft()
                accepted.append(len(times) < max(limit, 1) if not times else len(times) < limit)
                if accepted[-1]:
                    times.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_())], names=[*batch.schema.names, "accepted"])

    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "chat_id").sortWithinPartitions("chat_id", "t", "seq")
    return ordered.mapInArrow(run, schema)


def running_total(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all earlier rows in ``order``.

    Rows are dealt out in ranges of the order; each range adds up its own rows as a stream, and the sums of whole ranges,
    one number a range, are added to what follows.  No task ever holds or sorts all rows, however they cluster in time.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*rows.schema.fields, StructField("_range", IntegerType()), StructField("_inside", DoubleType()), StructField("_value", DoubleType())])

    def run(batches):
        here, total = TaskContext.get().partitionId(), 0.0
        for batch in batches:
            x = pc.fill_null(batch.column(batch.schema.get_field_index(value)).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
            sums = total + np.cumsum(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), here, np.int32)), pa.array(np.append(total, sums[:-1])[: len(x)]), pa.array(x)], names=schema.names)
            total = float(sums[-1]) if len(x) else total

    # read twice below, and the ranges of two runs may differ; written, so that no executor has to keep all rows
    inside = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    sums = inside.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    offsets = F.broadcast(sums.select("_range", earlier.alias("_earlier")))  # one row a partition
    return inside.join(offsets, "_range").withColumn("before", F.col("_earlier") + F.col("_inside")).drop("_range", "_inside", "_value", "_earlier")


def spend_cap(rows: DataFrame, cap: float, order: list[str], cost: str = "cost_usd") -> DataFrame:
    """Adds before and allowed: a row passes while the costs before it are below the cap.

    Costs are never negative, so that once the cap is reached it stays reached and refused rows need not be taken out.
    """
    return running_total(rows, cost, order).withColumn("allowed", F.round("before", 6) < cap)


def guard_pipeline(events: DataFrame, limit: int, longest: int, cap: float, window: float = WINDOW_SECONDS) -> DataFrame:
    """(chat_id, seq, t, text, cost_usd) and verdict: rate_limited, too_long, over_budget or ok; the first guard wins.

    A text that is too long has used up its place in the rate limit; only events that pass both are charged, so the
    others cost nothing in the running total.  Each row is judged on its own: keys may be null or repeated.
    """
    judged = rate_limit(events, limit, window, ("text", "cost_usd"))
    judged = judged.withColumn("verdict", F.when(~F.col("accepted"), "rate_limited").when(F.length("text") > longest, "too_long"))
    charged = judged.withColumn("_charged", F.when(F.col("verdict").isNull(), F.col("cost_usd")).otherwise(F.lit(0.0)))
    capped = spend_cap(charged, cap, ["t", "chat_id", "seq"], "_charged")
    return capped.withColumn("verdict", F.coalesce("verdict", F.when(F.col("allowed"), "ok").otherwise("over_budget"))).drop("before", "allowed", "_charged", "accepted")
