"""Chat histories as event logs: rows (chat_id, seq, op, role, text) with op append or reset."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAST_TURNS = 20
#: Charged when the agent fails and its real cost is not known.
FALLBACK_COST = 0.01


def since_reset(events: DataFrame) -> DataFrame:
    """Appended rows after the last reset of their chat."""
    resets = events.where("op = 'reset'").groupBy("chat_id").agg(F.max("seq").alias("_reset"))
    rows = events.where("op = 'append'").join(resets, "chat_id", "left")
    return rows.where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).drop("_reset")


def history(events: DataFrame, n: int = LAST_TURNS) -> DataFrame:
    """(chat_id, items): the last ``n`` turns since the last reset, oldest first."""
    place = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.col("seq").desc()))
    last = since_reset(events).withColumn("_place", place).where(F.col("_place") <= n)
    listed = F.array_sort(F.collect_list(F.struct("seq", "role", "text")))
    return last.groupBy("chat_id").agg(F.transform(listed, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("items"))


def stored(rows: DataFrame) -> DataFrame:
    """Rows (chat_id, items as JSON text) of a session store with items parsed; what is not a list of turns is an empty history."""
    items = F.when(F.btrim("items", F.lit(" \n\t\r")).startswith("["), F.from_json("items", "array<struct<role:string,text:string>>"))
    whole = F.forall(items, lambda x: x["role"].isNotNull() & x["text"].isNotNull())
    return rows.withColumn("items", F.when(F.coalesce(whole, F.lit(False)), items).otherwise(F.array().cast("array<struct<role:string,text:string>>")))


def settled(turns: DataFrame) -> DataFrame:
    """Questions with their outcome -> the log of appends and the costs.

    ``turns`` (chat_id, seq, question, answer, outcome, cost_usd): ok keeps question and answer at cost; a timeout keeps
    nothing at no cost; an error keeps the question at a fixed cost; a reset in flight drops the chat's history and the answer.
    """
    asked = turns.where("outcome in ('ok', 'error')").select("chat_id", (F.col("seq") * 2).alias("seq"), F.lit("append").alias("op"), F.lit("user").alias("role"), F.col("question").alias("text"))
    said = turns.where("outcome = 'ok'").select("chat_id", (F.col("seq") * 2 + 1).alias("seq"), F.lit("append").alias("op"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    reset = turns.where("outcome = 'reset'").select("chat_id", (F.col("seq") * 2).alias("seq"), F.lit("reset").alias("op"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return asked.unionByName(said).unionByName(reset)


def costs(turns: DataFrame) -> DataFrame:
    """(chat_id, seq, cost_usd) of what is charged."""
    amount = F.when(F.col("outcome").isin("ok", "reset"), F.col("cost_usd")).when(F.col("outcome") == "error", FALLBACK_COST)
    return turns.select("chat_id", "seq", amount.alias("cost_usd")).where("cost_usd is not null")


#: What a message that begins with a slash is for; other commands are ignored.
COMMANDS = {"start": "onboarding", "help": "onboarding", "reset": "reset"}


def routes(messages: DataFrame) -> DataFrame:
    """Adds route: onboarding, reset, ignored (unknown commands) or question."""
    named = F.create_map(*[F.lit(x) for pair in COMMANDS.items() for x in pair])[F.regexp_extract("text", r"^/(\w+)", 1)]
    return messages.withColumn("route", F.coalesce(named, F.when(F.col("text").startswith("/"), "ignored"), F.lit("question")))


def route_of(text: str) -> str:
    """The same for one text."""
    command = re.match(r"/([A-Za-z0-9_]+)", text)
    return COMMANDS.get(command[1] if command else "", "ignored" if text.startswith("/") else "question")
