"""Command line: chunk, ingest, search, evaluate, hybrid, benchmark, report, serve.

    python -m lectern chunk PAGES OUT [--pdf]     pages of marked text, or PDF files, -> chunks by both methods
    python -m lectern ingest CHUNKS --name NAME [--cache FOLDER]   embeds chunks and fills a collection
    python -m lectern search NAME TEXT [--filter EXPR] [--limit N]
    python -m lectern evaluate CHUNKS QUESTIONS OUT [--name NAME]  by words; with a collection by vectors and both, too
    python -m lectern hybrid CHUNKS QUESTIONS OUT --name NAME      the same, printed as a table of recall
    python -m lectern benchmark QUESTIONS FOLDER [--limit N] [--configs notools,rag,agent] [--budget USD] [--name NAME]
    python -m lectern report RECORDS
    python -m lectern serve MESSAGES FOLDER                        answers the messages of a folder of JSON lines

Models are callables of the library; the command line uses the stand-ins.
"""

from __future__ import annotations

import argparse
import json
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions.text import rfc_from_path
from lectern.operators import bm25, embedding, evaluation, rag, reporting
from lectern.operators.embedding import EmbeddingStore, hash_encoder
from lectern.plans import benchmark, hybrid
from lectern.plans.corpus import build_chunks, ingest
from lectern.sources import jsonl, pages
from lectern.sources.collection import Collection
from lectern.streaming.service import Service

MODEL = "hash-stub"


def chunk(spark: SparkSession, args) -> None:
    if args.pdf:
        pages.list_files(spark, args.pages)
        raw = pages.read_pdfs(spark, args.pages)
    else:
        name = F.regexp_replace(F.col("path"), r"\.\w+$", ".pdf")
        raw = pages.read_marked_text(spark, args.pages).withColumn("rfc", rfc_from_path(name))
    raw = raw.select("rfc", "pdf", F.lit(None).cast("int").alias("printed"), "text")
    for method in ("naive", "structural"):
        found = build_chunks(raw, method)
        jsonl.write(found.drop("start", "end"), f"{args.out}/{method}")
        print(method, spark.read.json(f"{args.out}/{method}").count())


def run_ingest(spark: SparkSession, args) -> None:
    collection, chunks = Collection(spark, args.name), jsonl.read(spark, args.chunks, schemas.CHUNK)
    store = EmbeddingStore(spark, args.cache) if args.cache else None
    cache = store.rows(MODEL) if store else spark.createDataFrame([], schemas.EMBEDDING_CACHE)
    n, fresh = ingest(chunks, cache, collection, MODEL, hash_encoder, recreate=not args.no_recreate)
    if store:
        store.upsert(fresh)
    print(n, collection.count())


def search(spark: SparkSession, args) -> None:
    vector = [float(x) for x in hash_encoder()([f"query: {args.text}"])[0]]
    asked = spark.createDataFrame([(1, vector)], "qid int, vector array<float>")
    Collection(spark, args.name).search(asked, args.limit, args.filter).orderBy("rank").show(truncate=80)


def _evaluated(spark: SparkSession, args):
    chunks = jsonl.read(spark, args.chunks, schemas.CHUNK).select(F.col("chunk_id").alias("id"), "text")
    questions = jsonl.read(spark, args.questions, schemas.QUESTION).where("answerable")
    asked = questions.select(F.col("id").alias("qid"), F.col("question").alias("text"))
    correct = evaluation.evidence_matches(chunks, questions.select(F.col("id").alias("qid"), F.col("evidence").alias("text")))
    if args.name:
        rows = spark.table(args.name).select(F.col("chunk_id").alias("id"), "vector")
        keyed = asked.select("qid", F.col("qid").alias("key"), "text")
        vectors = embedding.encode(keyed, hash_encoder, "query: ").select(F.col("key").alias("qid"), F.col("vec").alias("vector"))
        found = hybrid.hybrid(chunks, asked, rows, vectors)
    else:
        found = {"words": bm25.bm25_topk(chunks, asked, 10)}
    report = hybrid.evaluate(found, correct, asked)
    jsonl.write(report, args.out)
    return report


def evaluate(spark: SparkSession, args) -> None:
    _evaluated(spark, args).show()


def run_hybrid(spark: SparkSession, args) -> None:
    for r in reporting.recall_lines(_evaluated(spark, args)).collect():
        print(r["line"])


SYSTEM = "answer from the context"


def _agent():
    """A stand-in that asks the knowledge base its question once and repeats the first line of the reply."""

    def model(log: list[dict], tools: bool) -> dict:
        heard = [m["content"] for m in log if m["role"] == "tool"]
        if heard or not tools:
            return {"content": heard[0].split("\n", 1)[0] if heard else "", "cost_usd": 0.0}
        return {"content": "", "cost_usd": 0.0, "tool_calls": [{"id": "1", "arguments": json.dumps({"query": log[0]["content"]})}]}

    return model


def _by_retrieval(collection: Collection, questions):
    keyed = questions.select(F.col("qid").alias("key"), F.col("question").alias("text"))
    vectors = embedding.encode(keyed, hash_encoder, "query: ").select(F.col("key").alias("qid"), F.col("vec").alias("vector"))
    hits = collection.search(vectors, 5)
    ids = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    return rag.answer(questions, hits, SYSTEM).select("qid", "answer").join(ids, "qid", "left")


def _by_agents(collection: Collection, questions):
    rows = collection.spark.table(collection.name).select("chunk_id", "rfc", "section_path", F.col("page_start_printed").alias("page"), "text", "vector")
    return rag.run_agents(questions, _agent, rows.withColumn("rfc", F.col("rfc").cast("int")), hash_encoder)


def run_benchmark(spark: SparkSession, args) -> None:
    """A configuration is named by its mode, with whatever behind a hyphen: rag and agent take their passages from a collection."""
    run, questions = benchmark.Run(spark, args.folder, args.budget), jsonl.read(spark, args.questions, schemas.QUESTION)
    for name in args.configs.split(","):
        plan = {"rag": _by_retrieval, "agent": _by_agents}.get(name.split("-")[0])
        if plan is None:
            run.answer(questions, {name: benchmark.Configuration(MODEL, lambda: lambda q: {"answer": q, "cost_usd": 0.0})}, args.limit)
        elif args.name is None:
            raise SystemExit(f"{name} needs the name of a collection")
        else:
            run.answer_by_plan(questions, name, MODEL, partial(plan, Collection(spark, args.name)), args.limit)
    run.judge(lambda: lambda q, g, a: ("correct" if g and g in a else "wrong", 0.0))
    run.report().orderBy("config").show(truncate=False)


def report(spark: SparkSession, args) -> None:
    """Of several records of a pair the last one counts: by file, oldest first, then by place in the file."""
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    records = jsonl.read(spark, args.records, schemas.RECORD).withColumn("at", place)
    reporting.config_report(reporting.latest(records, "at", "config", "qid")).orderBy("config").show(truncate=False)


def serve(spark: SparkSession, args) -> None:
    service = Service(spark, args.folder, lambda: lambda question, history: {"answer": question, "cost_usd": 0.0, "sources": []}, args.limit, args.longest, args.cap)
    messages = spark.readStream.schema("chat_id long, seq long, t double, text string").json(args.messages)
    service.run_available(messages)
    service.replies().orderBy("chat_id", "seq").show(truncate=80)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lectern")
    commands = parser.add_subparsers(required=True)

    def add(name, run, *names, **options):
        p = commands.add_parser(name)
        for n in names:
            p.add_argument(n)
        p.set_defaults(run=run)
        return p

    add("chunk", chunk, "pages", "out").add_argument("--pdf", action="store_true")
    p = add("ingest", run_ingest, "chunks")
    p.add_argument("--name", default="chunks")
    p.add_argument("--cache")
    p.add_argument("--no-recreate", action="store_true")
    p = add("search", search, "name", "text")
    p.add_argument("--filter")
    p.add_argument("--limit", type=int, default=5)
    add("evaluate", evaluate, "chunks", "questions", "out").add_argument("--name")
    add("hybrid", run_hybrid, "chunks", "questions", "out").add_argument("--name", required=True)
    p = add("benchmark", run_benchmark, "questions", "folder")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--configs", default="notools")
    p.add_argument("--budget", type=float, default=benchmark.BUDGET)
    p.add_argument("--name")
    add("report", report, "records")
    p = add("serve", serve, "messages", "folder")
    for name, kind, default in (("--limit", int, 5), ("--longest", int, 1000), ("--cap", float, 1.0)):
        p.add_argument(name, type=kind, default=default)
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.appName("lectern").getOrCreate(), args)


if __name__ == "__main__":
    main()
