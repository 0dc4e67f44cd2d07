"""A benchmark run: every question under every configuration, resumed from a log, stopped by a budget, then judged.

The log is a folder of JSON lines that is only ever added to; each batch of answers is one addition, numbered, so the last
record of a pair is the one with the highest number.  A pair that the log holds is not asked again.  Before each batch
the costs in the log are added up; at the budget the run stops with an error and can be taken up later.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lectern.functions.text import parse_verdict
from lectern.operators.reporting import config_report, head_of_each, latest, unfinished, with_verdicts
from lectern.schemas import RECORD
from lectern.shared import cut
from lectern.sources import jsonl

BATCH, ROUND = 32, 10_000
BUDGET = 1.50
LOG = StructType([*RECORD.fields, StructField("at", LongType())])
#: question -> answer, cost_usd, tool_calls, steps, chunk_ids, prompt_tokens, completion_tokens; missing fields are empty.
Answerer = Callable[[str], dict]
#: (question, gold, answer) -> the judge's reply and its cost.
Judge = Callable[[str, str, str], tuple[str, float]]


class BudgetExceeded(RuntimeError):
    """The costs so far have reached the budget; what is answered is in the log."""


@dataclass
class Configuration:
    """A model's name and what makes its answerer on a worker."""

    model: str
    answerer: Callable[[], Answerer]


class Run:
    def __init__(self, spark: SparkSession, folder: str, budget: float = BUDGET, batch: int = BATCH):
        self.spark, self.folder, self.budget, self.batch = spark, folder.rstrip("/"), budget, batch

    def log(self) -> DataFrame:
        try:
            return jsonl.read(self.spark, f"{self.folder}/log", LOG)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], LOG)
            raise

    def records(self) -> DataFrame:
        """The last record of each pair."""
        return latest(self.log(), "at", "config", "qid")

    def _state(self) -> tuple[float, int]:
        """Costs in the log and the number of its next addition; a judged copy of a record repeats the record's cost."""
        row = self.log().groupBy("config", "qid").agg(F.max("cost_usd").alias("cost"), F.max("at").alias("at")).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent"), F.coalesce(F.max("at"), F.lit(0)).alias("at")).first()
        judged = self._judge_costs().agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent")).first()["spent"]
        return row["spent"] + judged, row["at"] + 1

    def _judge_costs(self) -> DataFrame:
        try:
            return self.spark.read.schema("config string, qid string, verdict string, cost_usd double").json(f"{self.folder}/verdicts")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], "config string, qid string, verdict string, cost_usd double")
            raise

    def _guard(self) -> int:
        spent, at = self._state()
        if spent >= self.budget:
            raise BudgetExceeded(f"spent {spent:.4f} of {self.budget:.4f}")
        return at

    def answer(self, questions: DataFrame, configurations: dict[str, Configuration], limit: int = 0) -> None:
        """Asks what the log lacks, configuration by configuration, in batches; ``limit`` keeps a head of each kind of question."""
        asked = head_of_each(questions, limit).select(F.col("id").alias("qid"), "question", F.col("answer").alias("gold"), "answerable")
        for name, configuration in configurations.items():
            config = self.spark.createDataFrame([(name,)], "config string")
            while True:
                rest = unfinished(config, asked, self.log()).orderBy("qid").limit(self.batch)
                part = rest.join(asked, "qid").persist()
                try:
                    if part.isEmpty():
                        break
                    at = self._guard()
                    jsonl.append(part.mapInPandas(_asking(configuration, at), LOG), f"{self.folder}/log")
                finally:
                    part.unpersist()

    def answer_by_plan(self, questions: DataFrame, name: str, model: str, plan: Callable[[DataFrame], DataFrame], limit: int = 0, at_once: int = ROUND) -> None:
        """The same for a configuration that answers many questions in one plan, such as retrieval or agents.

        ``plan`` takes (qid, question) and gives (qid, answer) with any of the other columns of a record.  The budget is looked
        at before each round of at most ``at_once`` questions, so it may be overrun by one round.
        """
        asked = head_of_each(questions, limit).select(F.col("id").alias("qid"), "question", F.col("answer").alias("gold"), "answerable")
        config = self.spark.createDataFrame([(name,)], "config string")
        while True:
            rest = cut(unfinished(config, asked, self.log()).orderBy("qid").limit(at_once).join(asked, "qid"))
            if rest.isEmpty():
                return
            at = self._guard()
            made = plan(rest.select("qid", "question"))
            known = {"at": F.lit(at), "model": F.lit(model), **{c: F.col(f"q.{c}") for c in rest.columns}, **{c: F.col(f"a.{c}") for c in made.columns if c not in rest.columns}}
            empty = {"cost_usd": F.lit(0.0), "steps": F.lit(1), "tool_calls": F.array(), "chunk_ids": F.array(), "prompt_tokens": F.lit(0), "completion_tokens": F.lit(0)}
            joined = rest.alias("q").join(made.alias("a"), F.col("q.qid") == F.col("a.qid"), "left")
            record = [F.coalesce(known.get(f.name, F.lit(None)).cast(f.dataType), empty[f.name].cast(f.dataType)) if f.name in empty else known.get(f.name, F.lit(None)).cast(f.dataType) for f in LOG.fields]
            jsonl.append(joined.select(*[c.alias(f.name) for c, f in zip(record, LOG.fields, strict=True)]), f"{self.folder}/log")

    def judge(self, judge: Callable[[], Judge]) -> None:
        """Adds a judged copy of every record without a verdict; verdicts that are known are not asked for again."""
        while True:
            open_ = self.records().where("verdict is null")
            known = self._judge_costs().dropDuplicates(["config", "qid"])
            cached = with_verdicts(open_, known).where("verdict is not null").persist()
            try:
                if not cached.isEmpty():
                    _, at = self._state()
                    jsonl.append(cached.withColumn("at", F.lit(at)), f"{self.folder}/log")
                    continue
            finally:
                cached.unpersist()
            part = open_.orderBy("config", "qid").limit(self.batch).select("config", "qid", "question", "gold", "answer")
            if part.isEmpty():
                return
            self._guard()
            replies = part.mapInPandas(_judging(judge), "config string, qid string, reply string, cost_usd double")
            jsonl.append(replies.select("config", "qid", parse_verdict(F.col("reply")).alias("verdict"), "cost_usd"), f"{self.folder}/verdicts")

    def report(self) -> DataFrame:
        return config_report(self.records())


def _asking(configuration: Configuration, at: int):
    def run(batches):
        ask = configuration.answerer()
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                made = ask(r["question"])
                record = {f: None for f in LOG.names} | r | {"model": configuration.model, "at": at}
                rows.append(record | {f: made.get(f, d) for f, d in (("answer", ""), ("cost_usd", 0.0), ("tool_calls", []), ("steps", 1), ("chunk_ids", []), ("prompt_tokens", 0), ("completion_tokens", 0))})
            yield pd.DataFrame(rows, columns=LOG.names)

    return run


def _judging(judge: Callable[[], Judge]):
    def run(batches):
        ask = judge()
        for pdf in batches:
            replies = [ask(q, g, a) for q, g, a in zip(pdf["question"], pdf["gold"], pdf["answer"], strict=True)]
            yield pd.DataFrame({"config": pdf["config"], "qid": pdf["qid"], "reply": [r for r, _ in replies], "cost_usd": [float(c) for _, c in replies]})

    return run
