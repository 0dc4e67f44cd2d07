"""The rate limit and chat sessions over streams of messages, with state keyed by chat."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.guards import WINDOW_SECONDS
from lectern.operators.sessions import LAST_TURNS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RATE_FIELDS = "chat_id long, seq long, t double, accepted boolean"
HISTORY_FIELDS = "chat_id long, seq long, items array<struct<role:string,text:string>>"


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """What one micro-batch brings for a chat; ``maxFilesPerTrigger`` and the like of the source bound it."""
    return pd.concat(list(rows)).sort_values(by)


class RateLimiter(StatefulProcessor):
    """State of a chat: its accepted times within the window, at most ``limit``.

    ``t`` is the time of arrival in seconds.  A timer drops the state of a chat that has been idle for a window, so state is
    kept for chats that are active only.
    """

    def __init__(self, limit: int, window: float = WINDOW_SECONDS):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.times.get() if self.times.exists() else None
        times = list(stored[0]) if stored else []
        events = _in_order(rows, ["t", "seq"])
        accepted = []
        for t in events["t"]:
            times = [x for x in times if t - x < self.window]
            accepted.append(not times or len(times) < self.limit)
            if accepted[-1]:
                times.append(t)
        self.times.update((times,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.window * 1000))
        yield events[["chat_id", "seq", "t"]].assign(accepted=accepted)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({"chat_id": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "t": pd.Series(dtype="float64"), "accepted": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


class SessionKeeper(StatefulProcessor):
    """State of a chat: its last turns; a reset clears them, an append is answered with the history so far."""

    def __init__(self, n: int = LAST_TURNS):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "role string, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = list(self.turns.get()) if self.turns.exists() else []
        out = []
        for r in _in_order(rows, ["seq"]).itertuples():
            turns = [] if r.op == "reset" else [*turns, (r.role, r.text)][-self.n :]
            out.append((key[0], r.seq, [{"role": a, "text": b} for a, b in turns]))
        if turns:
            self.turns.put(turns)
        else:
            self.turns.clear()
        yield pd.DataFrame(out, columns=["chat_id", "seq", "items"])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB provider: it takes the place of Spark's default, and a session that names a third one is an error."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in spark.conf.get(key, "HDFSBacked"):
        spark.conf.set(key, ROCKSDB)
    elif "RocksDB" not in spark.conf.get(key):
        raise ValueError(f"{key} must name the RocksDB provider")


@contextmanager
def no_empty_batches(spark: SparkSession) -> Iterator[None]:
    """For queries that start within: they run no batches for timers alone, so that one with ``availableNow`` ends."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _keyed(events: DataFrame, processor: StatefulProcessor, fields: str, time_mode: str = "none") -> DataFrame:
    use_rocksdb(events.sparkSession)
    return events.groupBy("chat_id").transformWithStateInPandas(processor, fields, "append", time_mode)


def rate_limited(events: DataFrame, limit: int, window: float = WINDOW_SECONDS) -> DataFrame:
    """A stream (chat_id, seq, t) with accepted."""
    return _keyed(events.select("chat_id", "seq", "t"), RateLimiter(limit, window), RATE_FIELDS, "processingTime")


def histories(events: DataFrame, n: int = LAST_TURNS) -> DataFrame:
    """A stream (chat_id, seq, op, role, text) -> the chat's last turns after each event."""
    return _keyed(events.select("chat_id", "seq", "op", "role", "text"), SessionKeeper(n), HISTORY_FIELDS)
