"""A chat service: messages in, guarded questions to an agent, rendered replies out, by three streams.

    messages, answers --charge--> events --converse--> turns --answer--> answers
                                                       turns --reply--> whoever sends them

* ``charge`` writes each batch's messages and answers with what the service had spent before them.  It keeps one number from
  batch to batch; a batch that is sent again replaces what it wrote.
* ``converse`` is the keyed state of ``chat.ChatProcessor``: guards, histories, one question a chat in flight.
* ``answer`` calls the agent for the questions asked, several at a time in a task, each with a deadline that is enforced.

Each stream has its own checkpoint and reads what the one before it has committed, so a service that is stopped goes on where
it was.  An agent may be asked twice if a task is lost meanwhile; its first answer counts, and nothing is said or charged
twice.  Batches cost what their own events cost, however old the service is.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from lectern.functions.rendering import LIMIT, render_answer
from lectern.operators.guards import WINDOW_SECONDS, running_total
from lectern.operators.sessions import FALLBACK_COST
from lectern.streaming.chat import EVENTS, LOST_AFTER, TURNS, ChatProcessor, conversations
from lectern.streaming.guards import no_empty_batches

#: What a refused message is answered with, by the guard that refused it, and what commands and failures are answered with.
REPLIES = {"rate_limited": "too many questions, wait a minute", "too_long": "the question is too long", "over_budget": "the budget is used up", "timeout": "no answer in time", "error": "no answer, try again", "onboarding": "ask a question about the documents", "reset": "the history is cleared"}
#: (question, history as a list of role and text) -> answer, cost_usd and sources (rfc, section, page).
Agent = Callable[[str, list[dict]], dict]

MESSAGES = "chat_id long, seq long, t double, text string"
ANSWERS = "chat_id long, seq long, t double, text string, outcome string, cost_usd double, sources string"
_SOURCES = "array<struct<rfc:int,section:string,page:int>>"
TIMEOUT, AT_ONCE = 60.0, 8


def charged(outcome: Column, cost: Column) -> Column:
    """A timeout costs nothing, an error a fixed amount, for want of the real one."""
    return F.when(outcome == "ok", F.coalesce(cost, F.lit(0.0))).when(outcome == "error", F.lit(FALLBACK_COST)).otherwise(F.lit(0.0))


class Service:
    def __init__(self, spark: SparkSession, folder: str, agent: Callable[[], Agent], limit: int, longest: int, cap: float, window: float = WINDOW_SECONDS, timeout: float = TIMEOUT, at_once: int = AT_ONCE, lost_after: float = LOST_AFTER):
        self.spark, self.folder, self.agent = spark, folder.rstrip("/"), agent
        self.limit, self.longest, self.cap, self.window = limit, longest, cap, window
        self.timeout, self.at_once, self.lost_after = timeout, at_once, lost_after

    # --- streams --------------------------------------------------------------------------------------------------

    def charge(self, messages: DataFrame) -> DataStreamWriter:
        """Of a stream (chat_id, seq, t, text), and of the answers."""
        none = lambda kind: F.lit(None).cast(kind)
        asked = messages.select("chat_id", "seq", "t", F.lit("message").alias("kind"), "text", none("string").alias("outcome"), none("double").alias("cost_usd"), none("string").alias("sources"))
        answers = self._stream("answers", ANSWERS).select("chat_id", "seq", "t", F.lit("answer").alias("kind"), "text", "outcome", "cost_usd", "sources")
        return self._checkpointed(asked.unionByName(answers).writeStream.foreachBatch(self._charge), "charge")

    def converse(self) -> DataStreamWriter:
        processor = ChatProcessor(self.limit, self.longest, self.cap, self.window, lost_after=self.lost_after)
        turns = conversations(self._stream("events", f"{EVENTS}, batch long").drop("batch"), processor)
        return self._checkpointed(turns.writeStream.format("parquet").option("path", f"{self.folder}/turns"), "converse")

    def answer(self) -> DataStreamWriter:
        asked = self._stream("turns", TURNS).where("kind = 'ask'").select("chat_id", "seq", "t", "text", "items")
        made = asked.mapInPandas(_asking(self.agent, self.timeout, self.at_once), ANSWERS)
        return self._checkpointed(made.writeStream.format("parquet").option("path", f"{self.folder}/answers"), "answer")

    def start(self, messages: DataFrame, every: str = "1 second") -> list[StreamingQuery]:
        """Serves until the queries are stopped."""
        return [w.trigger(processingTime=every).start() for w in (self.charge(messages), self.converse(), self.answer())]

    def run_available(self, messages: DataFrame) -> None:
        """Serves what is there, and ends when every question has its answer."""
        while True:
            for make in (lambda: self.charge(messages), self.converse, self.answer):
                with no_empty_batches(self.spark):
                    query = make().trigger(availableNow=True).start()
                query.awaitTermination()
            if not self._unheard():
                return

    # --- tables ---------------------------------------------------------------------------------------------------

    def turns(self) -> DataFrame:
        return self._table("turns", TURNS)

    def spend(self) -> DataFrame:
        """(chat_id, seq, cost_usd) of what was charged."""
        return self.turns().where("cost_usd > 0").select("chat_id", "seq", "cost_usd")

    def replies(self) -> DataFrame:
        """(chat_id, seq, parts) of everything that is said."""
        return self._spoken(self.turns())

    def reply(self) -> DataStreamWriter:
        """The same as a stream, for a sink of the caller's choice."""
        return self._checkpointed(self._spoken(self._stream("turns", TURNS)).writeStream, "reply")

    def _spoken(self, turns: DataFrame) -> DataFrame:
        said = F.create_map(*[F.lit(x) for pair in REPLIES.items() for x in pair])
        sources = F.coalesce(F.from_json("sources", _SOURCES), F.array().cast(_SOURCES))
        spoken = turns.where("kind <> 'ask'").select("chat_id", "seq", F.coalesce(said[F.col("kind")], "text").alias("text"), sources.alias("sources"))
        return spoken.select("chat_id", "seq", render_answer(F.col("text"), F.col("sources"), LIMIT).alias("parts"))

    # --- within ---------------------------------------------------------------------------------------------------

    def _made(self, name: str) -> str:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(path)
        return f"{self.folder}/{name}"

    def _stream(self, name: str, schema: str) -> DataFrame:
        return self.spark.readStream.schema(schema).parquet(self._made(name))

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self._made(name))

    def _checkpointed(self, writer: DataStreamWriter, name: str) -> DataStreamWriter:
        return writer.option("checkpointLocation", f"{self.folder}/checkpoints/{name}")

    def _charge(self, rows: DataFrame, batch: int) -> None:
        """Writes a batch's events with what was spent before them, and the sum for the next batch."""
        before = self.spark.read.schema("total double").parquet(f"{self.folder}/spent/batch={batch - 1}").first()[0] if batch else 0.0
        cost = F.when(F.col("kind") == "answer", charged(F.col("outcome"), F.col("cost_usd"))).otherwise(F.lit(0.0))
        summed = running_total(rows.withColumn("_charge", cost).withColumn("_answer", F.col("kind") == "answer"), "_charge", ["t", "chat_id", "seq", "_answer"])
        fields = [x.split()[0] for x in EVENTS.split(", ")]
        events = summed.withColumn("spent", F.col("before") + F.lit(before))
        events.select(*fields).write.mode("overwrite").parquet(f"{self.folder}/events/batch={batch}")
        total = events.agg((F.coalesce(F.sum("_charge"), F.lit(0.0)) + F.lit(before)).alias("total"))
        total.write.mode("overwrite").parquet(f"{self.folder}/spent/batch={batch}")

    def _unheard(self) -> bool:
        """Is there an answer that the conversations have not met yet?"""
        turns = self.turns().select("chat_id", "seq", "kind")
        over = turns.where("kind in ('answer', 'timeout', 'error')").select("chat_id", "seq")
        return not turns.where("kind = 'ask'").join(over, ["chat_id", "seq"], "left_anti").isEmpty()


def _asking(agent: Callable[[], Agent], timeout: float, at_once: int):
    """Questions with their histories -> answers, ``at_once`` calls at a time; a call that is not back in time is given up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = None
        for pdf in batches:
            ask = ask or agent()
            out = []
            for k in range(0, len(pdf), at_once):
                part = pdf.iloc[k : k + at_once]
                pool = ThreadPoolExecutor(at_once)  # a call that hangs keeps its thread, not the next ones'
                began = time.monotonic()
                calls = [pool.submit(ask, r.text, [dict(x) for x in r.items_]) for r in part.rename(columns={"items": "items_"}).itertuples()]
                for r, call in zip(part.itertuples(), calls, strict=True):
                    try:
                        made = {"answer": "", "cost_usd": 0.0, "sources": []} | call.result(max(0.0, began + timeout - time.monotonic()))
                        row = ("ok", made["answer"], float(made["cost_usd"]), json.dumps(made["sources"]))
                    except TimeoutError:
                        row = ("timeout", None, None, None)
                    except Exception:  # noqa: BLE001  the agent may be any service; its failure is an outcome
                        row = ("error", None, None, None)
                    out.append((r.chat_id, r.seq, r.t + (time.monotonic() - began), row[1], row[0], row[2], row[3]))
                pool.shutdown(wait=False, cancel_futures=True)
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERS.split(", ")])

    return run
