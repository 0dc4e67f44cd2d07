import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators import guards, rag, reporting, sessions
from lectern.operators.client import Client, OverBudget
from lectern.operators.embedding import hash_encoder
from lectern.plans import benchmark
from lectern.sources import jsonl, pages
from lectern.streaming import guards as streaming


def events(spark):
    rows = [(1, k, t, "x" * n, c) for k, (t, n, c) in enumerate([(0.0, 1, 1.0), (1.0, 99, 1.0), (2.0, 1, 1.0), (60.5, 1, 4.0), (60.9, 1, 1.0), (121.0, 1, 1.0)])]
    rows += [(2, 100, 5.0, "y", 2.0), (2, 101, 70.0, "y", 2.0)]
    return spark.createDataFrame(rows, "chat_id long, seq long, t double, text string, cost_usd double").repartition(3)


def test_refused_events_do_not_count(spark):
    got = {r.seq: r.accepted for r in guards.rate_limit(events(spark), 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True, 100: True, 101: True}


def test_guards_in_order(spark):
    got = {r.seq: r.verdict for r in guards.guard_pipeline(events(spark), 2, 10, 7.0).collect()}
    assert got == {0: "ok", 1: "too_long", 2: "rate_limited", 3: "ok", 4: "rate_limited", 100: "ok", 101: "over_budget", 5: "over_budget"}


def test_running_total_over_ranges(spark):
    df = spark.range(200).selectExpr("id as seq", "cast(id % 7 as double) as v", "'x' as other").repartition(5)
    got = {r.seq: r.before for r in guards.running_total(df, "v", ["seq"]).collect()}
    assert got == {k: float(sum(j % 7 for j in range(k))) for k in range(200)}
    assert guards.running_total(df.limit(0), "v", ["seq"]).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, 3.0), (None, 1.0)], "seq long, v double")
    assert sorted((r.seq or 0, r.before) for r in guards.running_total(nulls, "v", ["seq"]).collect()) == [(0, 0.0), (1, 1.0), (2, 1.0)]


def test_guards_judge_null_and_repeated_keys_row_by_row(spark):
    rows = [(None, 1, 0.0, "a", 1.0), (None, 1, 0.0, "a", 1.0), (None, 1, 0.0, "a", 1.0), (1, None, 5.0, "b", 1.0)]
    got = guards.guard_pipeline(spark.createDataFrame(rows, "chat_id long, seq long, t double, text string, cost_usd double"), 2, 10, 9.0).collect()
    assert sorted(r.verdict for r in got) == ["ok", "ok", "ok", "rate_limited"]


def test_streamed_rate_limit_equals_the_batch(spark, tmp_path):
    source = events(spark).orderBy("t").collect()
    for k in range(0, len(source), 3):  # several micro-batches
        spark.createDataFrame(source[k : k + 3], events(spark).schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/b{k}"))
    stream = spark.readStream.schema(events(spark).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    with streaming.no_empty_batches(spark):
        run = streaming.rate_limited(stream, 2).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert {(r.seq, r.accepted) for r in spark.table("limited").collect()} == {(r.seq, r.accepted) for r in guards.rate_limit(events(spark), 2).collect()}


def test_idle_chats_leave_no_state():
    """The processor by itself: a timer is kept a window ahead, and when it fires the state goes."""

    class Value:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.state, self.timers = Value(), []

        def getValueState(self, name, schema):
            return self.state

        def listTimers(self):
            return iter(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentProcessingTimeInMs(self):
            return self.ms

    limiter, handle = streaming.RateLimiter(1, 60.0), Handle()
    limiter.init(handle)
    for ms, t in ((1000, 1.0), (5000, 5.0)):
        out = pd.concat(limiter.handleInputRows((7,), iter([pd.DataFrame({"chat_id": [7], "seq": [ms], "t": [t]})]), Now(ms)))
        assert out["accepted"].tolist() == [ms == 1000] and handle.timers == [ms + 60_000]
    assert handle.state.exists()
    assert sum(len(x) for x in limiter.handleExpiredTimer((7,), Now(65_000), None)) == 0 and not handle.state.exists()


def log(spark):
    rows = [(1, 1, "append", "user", "a"), (1, 2, "append", "assistant", "b"), (1, 3, "reset", None, None), (1, 4, "append", "user", "c"), (2, 1, "append", "user", "d"), *[(3, k, "append", "user", f"m{k}") for k in range(30)]]
    return spark.createDataFrame(rows, "chat_id long, seq long, op string, role string, text string")


def test_histories(spark, tmp_path):
    got = {r.chat_id: [x.text for x in r["items"]] for r in sessions.history(log(spark)).collect()}
    assert got == {1: ["c"], 2: ["d"], 3: [f"m{k}" for k in range(10, 30)]}
    log(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log(spark).schema).parquet(str(tmp_path / "in"))
    run = streaming.histories(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = {}
    for r in spark.table("kept").orderBy("seq").collect():
        last[r.chat_id] = [x.text for x in r["items"]]
    assert last == got


def test_corrupt_histories_are_empty(spark):
    good = json.dumps([{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}])
    rows = [(1, good), (2, good[:-3]), (3, "{}"), (4, None), (5, '[{"role": "user"}]'), (6, "[]"), (7, "[1]"), (8, "oops")]
    got = {r.chat_id: [x.text for x in r["items"]] for r in sessions.stored(spark.createDataFrame(rows, "chat_id long, items string")).collect()}
    assert got == {1: ["a", "b"]} | {k: [] for k in range(2, 9)}


def test_outcomes_settle_history_and_costs(spark):
    turns = spark.createDataFrame([(1, 1, "q1", "a1", "ok", 0.2), (1, 2, "q2", None, "timeout", 0.0), (1, 3, "q3", None, "error", 0.0), (2, 1, "q", "a", "ok", 0.1), (2, 2, "r", "b", "reset", 0.3)], "chat_id long, seq long, question string, answer string, outcome string, cost_usd double")
    got = {r.chat_id: [x.text for x in r["items"]] for r in sessions.history(sessions.settled(turns)).collect()}
    assert got == {1: ["q1", "a1", "q3"]}
    assert {(r.chat_id, r.seq): r.cost_usd for r in sessions.costs(turns).collect()} == {(1, 1): 0.2, (1, 3): 0.01, (2, 1): 0.1, (2, 2): 0.3}


def records(spark):
    rows = [("a", "1", True, "wrong", 0.1, 0), ("a", "1", True, "correct", 0.2, 1), ("a", "2", True, "refused", 0.2, 2), ("a", "3", False, "refused", 0.2, 3), ("a", "4", False, "correct", 0.0, 4), ("b", "1", True, None, 9.0, 5), ("b", "2", True, "wrong", None, 6)]
    return spark.createDataFrame(rows, "config string, qid string, answerable boolean, verdict string, cost_usd double, seq long")


def test_reports(spark):
    last = reporting.latest(records(spark), "seq", "config", "qid")
    assert last.count() == 6
    got = {r.config: r for r in reporting.config_report(last).collect()}
    a, b = got["a"], got["b"]
    assert (a.n, a.accuracy, a.honest_refusals, a.false_refusals, a.cost_per_correct) == (4, 0.5, 0.5, 0.5, 0.6) and a.cost_per_question == pytest.approx(0.15)
    assert (b.n, b.accuracy, b.honest_refusals, b.cost_per_correct) == (1, 0.0, 0.0, None)
    table = reporting.presented(reporting.config_report(last), ["b", "a", "zz"]).collect()
    assert [(r.config, r.accuracy, r.cost_per_correct, r.refused_of_10) for r in table] == [("b", "0.00%", "—", "0"), ("a", "50.00%", "$0.6000", "5")]


def test_resume_verdicts_heads_and_prices(spark):
    configs, questions = spark.createDataFrame([("a",), ("b",)], "config string"), spark.createDataFrame([("1",), ("2",)], "qid string")
    assert {(r.config, r.qid) for r in reporting.unfinished(configs, questions, records(spark).where("config = 'a'")).collect()} == {("b", "1"), ("b", "2")}
    cache = spark.createDataFrame([("b", "1", "refused"), ("a", "1", "refused")], "config string, qid string, verdict string")
    got = {(r.config, r.qid, r.seq): r.verdict for r in reporting.with_verdicts(records(spark), cache).collect()}
    assert got[("b", "1", 5)] == "refused" and got[("a", "1", 0)] == "wrong"
    asked = spark.createDataFrame([(k, k % 3 > 0) for k in range(30)], "id long, answerable boolean")
    assert sorted(r.id for r in reporting.head_of_each(asked, 4).collect()) == [0, 1, 2, 4, 5] and reporting.head_of_each(asked, 0).count() == 30
    used = spark.createDataFrame([("m", 10, 5), ("x", 10, 5)], "model string, prompt_tokens int, completion_tokens int")
    assert {r.model: r.cost_usd for r in reporting.with_costs(used, spark.createDataFrame([("m", 0.1, 0.2)], "model string, prompt double, completion double")).collect()} == {"m": 2.0, "x": 0.0}


def test_answers_and_citations(spark):
    hits = spark.createDataFrame([("q", 1, "c1", 5, "9 X", 3, "one"), ("q", 2, "c2", 6, None, 4, "two"), ("q", 3, "c1", 5, "9 X", 3, "one"), ("r", 1, "c9", 7, None, None, "nine")], "qid string, rank int, chunk_id string, rfc int, section_path string, page int, text string")
    asked = spark.createDataFrame([("q", "why?"), ("none", "what?")], "qid string, question string")
    got = {r.qid: r.answer for r in rag.answer(asked, hits, "be brief").collect()}
    assert got == {"q": "[1] RFC 5 · §9 X", "none": rag.NOTHING}
    said = spark.createDataFrame([("q", "see [2], [3] and [1]"), ("r", "NO ANSWER [1]")], "qid string, answer string")
    assert [(r.pos, r.chunk_id) for r in rag.cited(said, hits, "NO ANSWER").orderBy("pos").collect()] == [(0, "c2"), (1, "c1")]
    judge = lambda: lambda ms: json.dumps({"verdict": "correct" if json.loads(ms[0]["content"])["answer"] == "x" else "wrong"})
    rows = spark.createDataFrame([("q", "g", "x"), ("q", "g", "y")], "question string, gold string, answer string")
    assert [r.verdict for r in rag.judged(rows, judge).orderBy("answer").collect()] == ["correct", "wrong"]


def test_agent_stops_after_its_steps():
    seen = []

    def model(log, tools):
        seen.append(tools)
        return {"content": "done", "cost_usd": 0.5, "tool_calls": [{"id": "1", "arguments": "{bad"}] if tools else []}

    got = rag.run_agent("q", model, lambda a: f"hits {a}", 2)
    assert got == {"answer": "done", "cost_usd": 1.5, "steps": 3, "tool_calls": ["{bad", "{bad"]} and seen == [True, True, False]


def test_agents_of_all_questions_equal_the_loop(spark):
    """Questions that take none, one, two and too many rounds, several calls a round, broken arguments, and odd numbers."""

    def factory():
        def model(log, tools):
            question, heard = log[0]["content"], [m["content"] for m in log if m["role"] == "tool"]
            rounds = int(question.split()[0])
            n = sum(m["role"] == "assistant" for m in log)
            if not tools or n >= rounds:
                return {"content": f"{question} after {len(heard)}: {' | '.join(heard)}", "cost_usd": 0.25, "tool_calls": []}
            asks = [{"query": f"{n}"}, {"query": f"{n + 3}", "rfc": 1}, {"query": "9", "rfc": 99}]
            calls = [{"id": f"{n}-{i}", "arguments": a} for i, a in enumerate(["{bad", "[1]", *map(__import__("json").dumps, asks)][: 2 + rounds])]
            return {"content": None if n else "wait", "cost_usd": 0.5, "tool_calls": calls}

        return model

    rows = [(f"c{k}", k % 2, None if k % 3 else f"{k} S", k, f"text {k}", [float(x) for x in hash_encoder(8)([f"query: {k}"])[0]]) for k in range(8)]
    table = spark.createDataFrame(rows, "chunk_id string, rfc int, section_path string, page int, text string, vector array<float>")
    questions = [(f"q{k}", f"{rounds} rounds") for k, rounds in enumerate([0, 1, 2, 3, 9, 0])]
    kb = rag.knowledge_base(table, hash_encoder(8), 2)
    tool = lambda a: kb(a.get("query", ""), a.get("rfc"))
    expected = {q: rag.run_agent(text, factory(), tool, 3) for q, text in questions}
    found = rag.run_agents(spark.createDataFrame(questions, "qid string, question string").repartition(3), factory, table, lambda: hash_encoder(8), 2, 3)
    assert {r.qid: {"answer": r.answer, "cost_usd": r.cost_usd, "steps": r.steps, "tool_calls": r.tool_calls} for r in found.collect()} == expected
    assert rag.run_agents(spark.createDataFrame([], "qid long, question string"), factory, table, lambda: hash_encoder(8)).count() == 0


def test_knowledge_base(spark):
    rows = [(f"c{k}", k % 2, None if k % 3 else f"{k} S", k, f"text {k}", [float(x) for x in hash_encoder(8)([f"query: {k}"])[0]]) for k in range(8)]
    table = spark.createDataFrame(rows, "chunk_id string, rfc int, section_path string, page int, text string, vector array<float>")
    tool = rag.knowledge_base(table, hash_encoder(8), 2)
    assert tool("3").startswith("[1] RFC 1 · §3 S\ntext 3\n\n[2] RFC ") and tool("3", 0).count("RFC 0") == 2
    assert tool("3", "1").startswith("[1] RFC 1 · §3 S") and tool("3", 99) == rag.NOTHING_FOUND
    with pytest.raises(ValueError):
        rag.number_filter("1 or true")
    calls = [(k, [float(x) for x in hash_encoder(8)([f"query: {k}"])[0]], rfc) for k, rfc in ((0, None), (1, 1), (2, 1), (3, 99))]
    got = {r.qid: r.reply for r in rag.tool_replies(spark.createDataFrame(calls, "qid int, vector array<float>, rfc int"), table, 1).collect()}
    assert got[0].endswith("text 0") and got[1].endswith("text 1") and "RFC 1" in got[2] and got[3] == rag.NOTHING_FOUND


def test_benchmark_resumes_stops_at_its_budget_and_judges(spark, tmp_path):
    rows = [(f"q{k}", f"question {k}", f"gold {k}", k < 4) for k in range(6)]
    questions = spark.createDataFrame(rows, "id string, question string, answer string, answerable boolean")

    def answerer():
        return lambda q: {"answer": q.upper(), "cost_usd": 0.25, "steps": 2, "chunk_ids": ["c"]}

    configurations = {"a": benchmark.Configuration("m1", answerer), "b": benchmark.Configuration("m2", answerer)}
    run = benchmark.Run(spark, str(tmp_path / "run"), budget=2.0, batch=4)
    with pytest.raises(benchmark.BudgetExceeded):
        run.answer(questions, configurations)
    assert run.log().count() == 10  # the batch that reaches the budget is finished, the next one is not begun
    run.budget = 100.0
    run.answer(questions, configurations)
    assert run.log().count() == 12 and {(r.config, r.qid) for r in run.records().collect()} == {(c, f"q{k}") for c in "ab" for k in range(6)}

    def judge():
        return lambda q, g, a: (json.dumps({"verdict": "refused" if g > "gold 3" else "correct" if a.endswith("1") else "wrong"}), 0.01)

    run.judge(judge)
    run.judge(judge)
    last = {(r.config, r.qid): r for r in run.records().collect()}
    assert run.log().count() == 24 and last[("a", "q1")].verdict == "correct" and last[("b", "q5")].verdict == "refused" and last[("b", "q5")].chunk_ids == ["c"]
    assert {r.config: (r.n, r.accuracy, r.honest_refusals) for r in run.report().collect()} == {c: (6, 0.25, 1.0) for c in "ab"}
    planned = benchmark.Run(spark, str(tmp_path / "planned"), budget=1.0)
    plan = lambda q: q.select("qid", F.concat(F.lit("re: "), "question").alias("answer"), F.lit(0.3).alias("cost_usd"))
    with pytest.raises(benchmark.BudgetExceeded):
        planned.answer_by_plan(questions, "p", "m", plan, at_once=2)
    assert planned.log().count() == 4  # two rounds of two: the second ends beyond the budget
    planned.budget = 9.0
    planned.answer_by_plan(questions, "p", "m", plan, at_once=2)
    planned.answer_by_plan(questions, "p", "m", plan)
    got = planned.log().collect()
    assert len(got) == len({r.qid for r in got}) == 6 and all(r.answer.startswith("re: ") and r.model == "m" and r.steps == 1 and r.tool_calls == [] for r in got)
    small = benchmark.Run(spark, str(tmp_path / "small"))
    small.answer(questions, {"a": configurations["a"]}, limit=2)
    assert small.log().count() == 3


def test_client_retries_adds_up_and_stops():
    sent, pauses = [], []

    def transport(request):
        sent.append(request)
        if len(sent) < 3:
            raise ConnectionError
        return {"content": None, "usage": {"prompt_tokens": 10, "completion_tokens": None, "cost": None if len(sent) == 3 else 0.5}}

    client = Client(transport, 0.6, {"m": (0.01, 0.02)}, pause=pauses.append)
    assert client.chat("m", [])["content"] == "" and pauses == [2.0, 4.0] and client.rows == [{"model": "m", "prompt_tokens": 10, "completion_tokens": 0, "cost_usd": 0.1}]
    assert client.chat("x", [], max_tokens=5)["cost_usd"] == 0.5 and sent[-1]["max_tokens"] == 5
    with pytest.raises(OverBudget):
        client.chat("m", [])
    with pytest.raises(RuntimeError):
        Client(lambda r: (_ for _ in ()).throw(TimeoutError()), 1.0, pause=lambda s: None).chat("m", [])


def test_recall_lines_and_usage(spark):
    report = spark.createDataFrame([("hybrid", 0.5, 1.0), ("words", 0.25, 0.3333), ("vector", 0.0, 0.1)], "source string, recall_1 double, recall_3 double")
    lines = [r.line for r in reporting.recall_lines(report, (1, 3)).collect()]
    assert lines == ["source           @1       @3", "vector        0.000    0.100", "words         0.250    0.333", "hybrid        0.500    1.000"]
    used = spark.createDataFrame([("a", 1, None, 0.5), ("a", 2, 3, None)], "model string, prompt_tokens int, completion_tokens int, cost_usd double")
    assert tuple(reporting.usage_totals(used, "model").first()) == ("a", 2, 3, 3, 0.5)


def test_files(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "chat_id": 1, "cost_usd": 0.5}\n\n{"ts": \noops\n{"cost_usd": NaN}\n{"chat_id": 2, "cost_usd": 0.25}\n')
    journal = jsonl.read_journal(spark, str(tmp_path / "j.jsonl"))
    assert journal.count() == 2 and jsonl.total_spend(journal).first().total == 0.75
    df = spark.createDataFrame([("a", "ж", None)], "method string, text string, n int")
    jsonl.write(df, str(tmp_path / "out"), by="method")
    jsonl.append(df, str(tmp_path / "log"))
    jsonl.append(df, str(tmp_path / "log"))
    assert "ж" in next((tmp_path / "out" / "method=a").glob("*.json")).read_text()
    assert jsonl.read(spark, str(tmp_path / "log"), df.schema).count() == 2
    (tmp_path / "v.json").write_text('{"a/q/1": "correct"}')
    assert tuple(jsonl.read_verdicts(spark, str(tmp_path / "v.json")).first()) == ("a", "q/1", "correct")
    (tmp_path / "p.json").write_text('{"m": {"prompt": 0.1, "completion": 0.2}}')
    assert tuple(jsonl.read_prices(spark, str(tmp_path / "p.json")).first()) == ("m", 0.1, 0.2)
    (tmp_path / "d.txt").write_text("one\n%%PAGE%%\ntwo")
    assert [(r.pdf, r.text) for r in pages.read_marked_text(spark, str(tmp_path / "d.txt")).orderBy("pdf").collect()] == [(0, "one\n"), (1, "two")]
    with pytest.raises(FileNotFoundError):
        pages.list_files(spark, str(tmp_path), "*.pdf")
