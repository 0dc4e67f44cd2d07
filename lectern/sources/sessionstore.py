"""Chat sessions as a log with snapshots: reading chats costs their snapshot and the tail of the log behind it.

Tables in a folder, all plain Parquet:

* ``log/batch=<n>``: events (chat_id, seq, op, role, text) of a batch, op append or reset; writing a batch again replaces it;
* ``snapshots/upto=<n>/bucket=<b>``: the events of batches up to n that still count, the last turns of each chat since its reset;
* ``marks/upto=<n>``: written behind a snapshot, so that one without its mark is as if it were not there.

A chat's events rise in ``seq`` from batch to batch.  Folding reads the newest snapshot and the log behind it, and leaves the log as
it is; a failure at any point of it changes nothing that is read.  Events with a null id belong to no chat and are left out.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.sessions import LAST_TURNS, history, since_reset

EVENTS = "chat_id long, seq long, op string, role string, text string"
BUCKETS = 64


class SessionStore:
    def __init__(self, spark: SparkSession, folder: str, n: int = LAST_TURNS, buckets: int = BUCKETS):
        self.spark, self.folder, self.n, self.buckets = spark, folder.rstrip("/"), n, buckets

    def append(self, events: DataFrame, batch: int) -> None:
        """Adds the events of a batch; batches are numbered upwards from 0."""
        events.where("chat_id is not null").select("chat_id", "seq", "op", "role", "text").write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")

    def events(self, chats: list[int] | None = None) -> DataFrame:
        """The events that count for ``chats`` (all by default): those of the newest snapshot, and the log behind it."""
        upto = self._upto()
        tail = self._read("log", "batch long").where(F.col("batch") > upto).drop("batch")
        kept = self._read("snapshots", "upto long, bucket int").where(F.col("upto") == upto)
        if chats is not None:
            asked = F.col("chat_id").isin(chats)
            wanted = self.spark.createDataFrame([(x,) for x in chats], "chat_id long").select(self._bucket(F.col("chat_id"))).distinct()
            kept = kept.where(F.col("bucket").isin([r[0] for r in wanted.collect()]) & asked)
            tail = tail.where(asked)
        return kept.drop("upto", "bucket").unionByName(tail)

    def history(self, chats: list[int] | None = None) -> DataFrame:
        """(chat_id, items): the last turns of each chat since its reset, oldest first; chats without any are left out."""
        return history(self.events(chats), self.n)

    def fold(self) -> int:
        """Writes a snapshot of everything so far; gives the number of the last batch in it, -1 if there is none."""
        newest = self._read("log", "batch long").agg(F.max("batch")).first()[0]
        if newest is None or newest == self._upto():
            return self._upto()
        place = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.col("seq").desc()))
        kept = since_reset(self.events()).withColumn("_place", place).where(F.col("_place") <= self.n).drop("_place")
        bucketed = kept.withColumn("bucket", self._bucket(F.col("chat_id"))).hint("rebalance", "bucket")
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/snapshots/upto={newest}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/marks/upto={newest}")
        return newest

    def _bucket(self, chat_id: Column) -> Column:
        return F.pmod(F.xxhash64(chat_id), F.lit(self.buckets)).cast("int")

    def _upto(self) -> int:
        found = self._table("marks", "id long, upto long").agg(F.max("upto")).first()[0]
        return -1 if found is None else found

    def _read(self, name: str, more: str) -> DataFrame:
        return self._table(name, f"{EVENTS}, {more}")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)


class MemorySessions:
    """The same without a folder, for tests and short-lived services: the driver holds the events of each batch."""

    def __init__(self, spark: SparkSession, n: int = LAST_TURNS):
        self.spark, self.n, self.batches = spark, n, {}

    def append(self, events: DataFrame, batch: int) -> None:
        self.batches[batch] = [tuple(r) for r in events.where("chat_id is not null").select("chat_id", "seq", "op", "role", "text").collect()]

    def events(self, chats: list[int] | None = None) -> DataFrame:
        return self.spark.createDataFrame([r for rows in self.batches.values() for r in rows if chats is None or r[0] in chats], EVENTS)

    def history(self, chats: list[int] | None = None) -> DataFrame:
        return history(self.events(chats), self.n)

    def fold(self) -> int:
        return max(self.batches, default=-1)
