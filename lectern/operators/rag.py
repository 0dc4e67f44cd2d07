"""Answering over retrieved passages, as batch steps around an external model.

The model is a callable from messages to text and may be any service; ``echo_model`` stands in for one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lectern.functions.text import citation_numbers, format_hit, is_refusal, normal_refusal, parse_verdict, tool_arguments
from lectern.operators.embedding import Encoder, encode
from lectern.operators.vectors import vector_topk
from lectern.shared import cut

Model = Callable[[list[dict]], str]
#: Sent in place of a context without hits, and as a tool's reply without hits. Fixed values.
NOTHING = "(пусто)"
NOTHING_FOUND = "Ничего не найдено по этому запросу."
MOST_STEPS = 4
#: Calls of a model that a task makes side by side.
AT_ONCE = 8
_ASKED = "array<struct<id:string,arguments:string>>"
_HEARD = "array<struct<id:string,content:string>>"


def contexts(hits: DataFrame) -> DataFrame:
    """(qid, rank, rfc, section_path, page, text) -> (qid, context): numbered blocks with blank lines between them."""
    block = format_hit(F.col("rank"), F.col("rfc"), F.col("section_path"), F.col("page"), F.col("text"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("block"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["block"]), "\n\n").alias("context"))


def messages(question: Column, context: Column, system: str) -> Column:
    """array<struct<role,content>>; a question without hits gets a mark in place of its context."""
    body = F.concat(F.coalesce(F.nullif(context, F.lit("")), F.lit(NOTHING)), F.lit("\n\n"), question)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), body.alias("content")))


def number_filter(rfc: int | str | None) -> Column:
    """The filter of a search: rows of one document, or all rows; anything but a whole number is an error."""
    return F.lit(True) if rfc is None else F.col("rfc") == int(rfc)


def tool_replies(calls: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """``calls`` (qid, vector, rfc) with reply: the formatted hits among ``rows``, within the document asked for if one is.

    ``rows`` (chunk_id, rfc, section_path, page, text, vector) are searched once for all calls, however many documents these
    name.
    """
    found = vector_topk(rows.withColumnRenamed("chunk_id", "id"), calls, k, within="rfc")
    facts = rows.select(F.col("chunk_id").alias("id"), "rfc", "section_path", "page", "text")
    replies = contexts(found.join(facts, "id"))
    return calls.join(replies, "qid", "left").withColumn("reply", F.coalesce("context", F.lit(NOTHING_FOUND))).drop("context")


def knowledge_base(rows: DataFrame, encode: Callable[[list[str]], "object"], k: int = 5) -> Callable[..., str]:
    """The agent's tool: ``(query, rfc=None)`` -> the formatted hits, or that nothing was found."""

    def tool(query: str, rfc: int | None = None) -> str:
        vector = [float(x) for x in encode([f"query: {query}"])[0]]
        call = rows.sparkSession.createDataFrame([(1, vector, None if rfc is None else int(rfc))], "qid int, vector array<float>, rfc int")
        return tool_replies(call, rows, k).first()["reply"]

    return tool


def echo_model() -> Model:
    return lambda ms: ms[-1]["content"].split("\n", 1)[0]


def answer(questions: DataFrame, hits: DataFrame, system: str, model_factory: Callable[[], Model] = echo_model) -> DataFrame:
    """``questions`` (qid, question) with context and answer."""
    joined = questions.join(contexts(hits), "qid", "left").withColumn("messages", messages(F.col("question"), F.col("context"), system))

    def run(batches):
        model = model_factory()
        for pdf in batches:
            yield pdf.assign(answer=[model([dict(m) for m in ms]) for ms in pdf["messages"]])

    return joined.mapInPandas(run, StructType([*joined.schema.fields, StructField("answer", StringType())])).drop("messages")


def judged(answers: DataFrame, model_factory: Callable[[], Model]) -> DataFrame:
    """``answers`` (question, gold, answer) with the verdict of a judge."""
    fields = StructType([*answers.schema.fields, StructField("_reply", StringType())])

    def run(batches):
        model = model_factory()
        for pdf in batches:
            yield pdf.assign(_reply=[model([{"role": "user", "content": json.dumps({"question": q, "gold": g, "answer": a}, ensure_ascii=False)}]) for q, g, a in zip(pdf["question"], pdf["gold"], pdf["answer"], strict=True)])

    return answers.mapInPandas(run, fields).withColumn("verdict", parse_verdict(F.col("_reply"))).drop("_reply")


def cited(answers: DataFrame, hits: DataFrame, refusal: str) -> DataFrame:
    """(qid, answer) and hits (qid, rank, ...) -> one row for each hit an answer cites, in order; none for refusals.

    Without a valid citation the first hit counts; of hits with the same id the first stays.
    """
    n = hits.groupBy("qid").agg(F.max("rank").cast("int").alias("n"))
    plain = answers.join(n, "qid").where(~is_refusal(F.col("answer"), refusal)).withColumn("answer", normal_refusal(F.col("answer"), refusal))
    named = plain.select("qid", F.posexplode(citation_numbers(F.col("answer"), F.col("n"))).alias("pos", "rank"))
    found = named.join(hits, ["qid", "rank"])
    first = found.groupBy("qid", "chunk_id").agg(F.min("pos").alias("pos"))
    return found.join(first, ["qid", "chunk_id", "pos"])


def run_agents(questions: DataFrame, model_factory: Callable[[], Callable[[list[dict], bool], dict]], rows: DataFrame, encoder_factory: Callable[[], Encoder], k: int = 5, most_steps: int = MOST_STEPS, at_once: int = AT_ONCE) -> DataFrame:
    """What :func:`run_agent` gives, for all ``questions`` (qid, question) at once: (qid, answer, cost_usd, steps, tool_calls).

    Each round is a plan over the questions that are still open: their models are called on the tasks, ``at_once`` at a time;
    all tool calls of the round are encoded and searched together; the replies go back to their questions.  There are at most
    ``most_steps`` + 1 rounds, each written before the next, so one that is lost is not asked again as a whole.  Arguments that
    are no object count as none, and a document number that is no whole number finds nothing.
    """
    spark = questions.sparkSession
    kind = questions.schema["qid"].dataType.simpleString()
    spoken_fields = f"qid {kind}, log string, cost_usd double, steps int, tool_calls array<string>, content string, asked {_ASKED}"
    none = F.array().cast(_HEARD)
    open_ = questions.select("qid", F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))).alias("log"), F.lit(0.0).alias("cost_usd"), F.lit(0).alias("steps"), F.array().cast("array<string>").alias("tool_calls"), none.alias("heard"))
    done = spark.createDataFrame([], f"qid {kind}, answer string, cost_usd double, steps int, tool_calls array<string>")
    for step in range(most_steps + 1):
        tools = step < most_steps
        spoken = cut(open_.mapInPandas(_speaking(model_factory, tools, at_once), spoken_fields))
        over = (F.size("asked") == 0) if tools else F.lit(True)
        done = done.unionByName(spoken.where(over).select("qid", F.col("content").alias("answer"), "cost_usd", "steps", "tool_calls"))
        going = spoken.where(~over)
        if not tools or going.isEmpty():
            break
        calls = going.select("qid", F.posexplode("asked").alias("pos", "call")).withColumn("key", F.concat_ws(":", F.col("qid").cast("string"), "pos"))
        named = tool_arguments(F.col("call.arguments"))
        calls = calls.select("qid", "pos", "key", "call.id", F.coalesce(named["query"], F.lit("")).alias("text"), named["rfc"].alias("named"), named["rfc"].try_cast("int").alias("rfc"))
        vectors = encode(calls.select("key", "text"), encoder_factory, "query: ")
        able = calls.where("named is null or rfc is not null").join(vectors, "key").select(F.col("key").alias("qid"), F.col("vec").alias("vector"), "rfc")
        replies = tool_replies(cut(able), rows, k).select(F.col("qid").alias("key"), "reply")
        heard = calls.join(replies, "key", "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("reply", F.lit(NOTHING_FOUND)).alias("content")))).alias("heard"))
        open_ = going.join(heard, "qid").select("qid", "log", "cost_usd", "steps", "tool_calls", F.transform("heard", lambda x: F.struct(x["id"].alias("id"), x["content"].alias("content"))).cast(_HEARD).alias("heard"))
    return done


def _speaking(model_factory: Callable, tools: bool, at_once: int):
    """One call of the model for each open question, its log first taken on by what the tools have said."""

    def run(batches):
        model = None
        for pdf in batches:
            model = model or model_factory()
            logs = [json.loads(log) for log in pdf["log"]]
            for log, heard in zip(logs, pdf["heard"], strict=True):
                log += [{"role": "tool", "tool_call_id": h["id"], "content": h["content"]} for h in heard]
            with ThreadPoolExecutor(at_once) as pool:
                replies = list(pool.map(lambda log: model(log, tools), logs))
            out = []
            for r, log, reply in zip(pdf.to_dict("records"), logs, replies, strict=True):
                content, asked = reply.get("content") or "", (reply.get("tool_calls") or []) if tools else []
                asked = [{"id": c.get("id"), "arguments": c.get("arguments") or "{}"} for c in asked]
                log.append({"role": "assistant", "content": content, "tool_calls": asked})
                out.append((r["qid"], json.dumps(log, ensure_ascii=False), r["cost_usd"] + (reply.get("cost_usd") or 0.0), r["steps"] + 1, [*r["tool_calls"], *(c["arguments"] for c in asked)], content, asked))
            yield pd.DataFrame(out, columns=["qid", "log", "cost_usd", "steps", "tool_calls", "content", "asked"])

    return run


def run_agent(question: str, model: Callable[[list[dict], bool], dict], tool: Callable[[dict], str], most_steps: int = MOST_STEPS) -> dict:
    """At most ``most_steps`` rounds of tool calls, then an answer without tools; costs add up over all replies.

    ``model(messages, tools)`` returns content, cost_usd and tool_calls (each id and arguments as JSON text).
    """
    log, cost, calls = [{"role": "user", "content": question}], 0.0, []
    for step in range(most_steps + 1):
        reply = model(log, step < most_steps)
        cost += reply.get("cost_usd") or 0.0
        asked = reply.get("tool_calls") or []
        if step == most_steps or not asked:
            return {"answer": reply.get("content") or "", "cost_usd": cost, "steps": step + 1, "tool_calls": calls}
        log.append({"role": "assistant", "content": reply.get("content") or "", "tool_calls": asked})
        for call in asked:
            try:
                arguments = json.loads(call.get("arguments") or "{}")
            except ValueError:
                arguments = {}
            calls.append(call.get("arguments") or "{}")
            log.append({"role": "tool", "tool_call_id": call.get("id"), "content": tool(arguments if isinstance(arguments, dict) else {})})
    raise AssertionError("unreachable")


