"""The chat's keyed state by itself, cut into batches at will, and the service over streams."""

import random
import time

import pandas as pd
import pytest

from lectern.operators import guards
from lectern.operators.sessions import FALLBACK_COST
from lectern.streaming import chat as chats
from lectern.streaming import service as service_module
from lectern.streaming.service import Service

NAMES = [x.split()[0] for x in chats.EVENTS.split(", ")]


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    getListState = getValueState

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class Clock:
    def __init__(self, ms=1000):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def message(seq, t, text, spent=0.0, chat=7):
    return (chat, seq, t, "message", text, spent, None, None, None)


def answer(seq, t, text="yes", outcome="ok", cost=0.5, chat=7):
    return (chat, seq, t, "answer", text, None, outcome, cost, "[]")


class Chat:
    """One chat's processor, made anew for every batch over the same state, as Spark does it."""

    def __init__(self, **options):
        self.options = {"limit": 2, "longest": 10, "cap": 5.0} | options
        self.handle, self.clock, self.said = Handle(), Clock(), []

    def processor(self):
        p = chats.ChatProcessor(**self.options)
        p.init(self.handle)
        return p

    def batch(self, *events):
        made = pd.concat(list(self.processor().handleInputRows((7,), iter([pd.DataFrame(list(events), columns=NAMES)]), self.clock)))
        self.said += [tuple(r) for r in made[["seq", "t", "kind", "text"]].itertuples(index=False)]
        return made

    def expire(self):
        made = pd.concat(list(self.processor().handleExpiredTimer((7,), self.clock, None)))
        self.said += [tuple(r) for r in made[["seq", "t", "kind", "text"]].itertuples(index=False)]

    @property
    def history(self):
        return self.handle.states["history"].value or []

    def kinds(self):
        return [(seq, kind) for seq, _, kind, _ in self.said]


def test_a_question_waits_for_the_one_in_flight():
    c = Chat()
    c.batch(message(1, 0.0, "one"), message(2, 1.0, "two"), message(3, 2.0, "three"))
    assert c.kinds() == [(1, "ask"), (3, "rate_limited")] and c.history == [("user", "one")]
    made = c.batch(answer(1, 5.0))
    assert c.kinds()[2:] == [(1, "answer"), (2, "ask")]
    assert made["items"].iloc[1] == [{"role": "user", "text": "one"}, {"role": "assistant", "text": "yes"}] and made["cost_usd"].iloc[0] == 0.5
    c.batch(answer(1, 5.0), answer(9, 6.0), message(2, 1.0, "two"))  # come again, and unknown
    assert len(c.said) == 4


def test_a_reset_while_a_question_is_open_keeps_neither_question_nor_answer():
    c = Chat(limit=9)
    c.batch(message(1, 0.0, "one"), answer(1, 1.0), message(2, 2.0, "two"), message(3, 3.0, "/reset"))
    assert c.history == [] and c.kinds()[-1] == (3, "reset")
    made = c.batch(answer(2, 4.0, cost=0.25))
    assert c.kinds()[-1] == (2, "answer") and c.history == [] and made["cost_usd"].iloc[0] == 0.25  # said and charged, not kept
    c.batch(message(4, 5.0, "four"), message(5, 6.0, "/reset"), answer(4, 7.0, None, "timeout"))
    assert c.kinds()[-1] == (4, "timeout") and c.history == []


def test_a_timeout_takes_the_question_back_and_an_error_leaves_it():
    c = Chat(limit=9)
    c.batch(message(1, 0.0, "one"), answer(1, 1.0), message(2, 2.0, "two"))
    made = c.batch(answer(2, 3.0, None, "timeout"))
    assert c.history == [("user", "one"), ("assistant", "yes")] and made["cost_usd"].isna().all()
    made = c.batch(message(3, 4.0, "three"), answer(3, 5.0, None, "error", None))
    assert c.history == [("user", "one"), ("assistant", "yes"), ("user", "three")] and made["cost_usd"].iloc[1] == FALLBACK_COST


def test_a_timer_ends_a_question_whose_answer_is_lost():
    c = Chat(limit=9, lost_after=30.0)
    c.batch(message(1, 0.0, "one"), message(2, 1.0, "two"))
    assert c.handle.timers == [31_000]
    c.clock.ms = 20_000
    c.expire()
    assert c.kinds() == [(1, "ask")] and c.handle.timers == [31_000]
    c.clock.ms = 31_000
    c.expire()
    assert c.kinds() == [(1, "ask"), (1, "timeout"), (2, "ask")] and c.history == [("user", "two")] and c.handle.timers == [61_000]
    c.batch(answer(1, 40.0), answer(2, 41.0))
    assert c.kinds()[3:] == [(2, "answer")] and c.handle.timers == []


def test_guards_come_in_their_order_and_commands_use_up_nothing():
    c = Chat(limit=2)
    c.batch(message(1, 0.0, "/start"), message(2, 0.0, "/other"), message(3, 0.0, "x" * 11, 9.0), message(4, 0.5, "", 9.0), message(5, 1.0, "x" * 11, 9.0), message(6, 61.0, None, 1.0))
    assert c.kinds() == [(1, "onboarding"), (3, "too_long"), (4, "over_budget"), (5, "rate_limited"), (6, "ask")]


def scenario(seed):
    """Messages, the answers to all of them right behind, what was spent before, and the batch guards' verdicts."""
    r = random.Random(seed)
    events, t, spent, times, verdicts = [], 0.0, 0.0, [], {}
    for seq in range(60):
        t += r.choice([0.0, 1.0, 5.0, 20.0, 59.0, 60.0])
        text = r.choice(["hello", "hello", "x" * 11, "/reset", "/help", "/x"])
        events.append(message(seq, t, text, spent))
        if text.startswith("/"):
            continue
        times = [x for x in times if t - x < 60.0]
        verdict = "rate_limited" if len(times) >= 2 else "too_long" if len(text) > 10 else "over_budget" if spent >= 5.0 else "ok"
        times += [t] if verdict != "rate_limited" else []
        verdicts[seq] = verdict
        outcome = r.choice(["ok", "ok", "error", "timeout"])
        events.append(answer(seq, t, f"a{seq}", outcome, 0.5))
        if verdict == "ok":
            spent += {"ok": 0.5, "error": FALLBACK_COST, "timeout": 0.0}[outcome]
    return events, verdicts


@pytest.mark.parametrize("seed", range(8))
def test_every_cut_into_batches_gives_the_same(seed):
    events, verdicts = scenario(seed)
    whole = Chat()
    whole.batch(*events)
    got = {seq: "ok" if kind == "ask" else kind for seq, kind in whole.kinds() if kind in ("ask", "rate_limited", "too_long", "over_budget")}
    assert got == verdicts
    r = random.Random(seed)
    for share in (1.0, 0.5, 0.1):
        cut = Chat()
        part = []
        for e in events:
            part.append(e)
            if r.random() < share:
                cut.batch(*part)
                if r.random() < 0.2:
                    cut.batch(*part)  # sent again
                part = []
        if part:
            cut.batch(*part)
        assert cut.said == whole.said and cut.history == whole.history


def test_verdicts_equal_the_batch_guards(spark):
    """The list of times at which a refused message was counted once: 100 is accepted, as 50 does not count."""
    times = [0.0, 10.0, 50.0, 65.0, 100.0]
    rows = spark.createDataFrame([(7, k, t, "q", 0.0) for k, t in enumerate(times)], "chat_id long, seq long, t double, text string, cost_usd double")
    expected = {r.seq: r.accepted for r in guards.rate_limit(rows, 2).collect()}
    assert expected == {0: True, 1: True, 2: False, 3: True, 4: True}
    for n in (1, 2, 3, 5):
        c = Chat()
        for k in range(0, 5, n):
            c.batch(*[e for i, t in list(enumerate(times))[k : k + n] for e in (message(i, t, "q"), answer(i, t))])
        assert {seq: kind == "ask" for seq, kind in c.kinds() if kind in ("ask", "rate_limited")} == expected


def test_state_stays_bounded():
    c = Chat(limit=3, longest=1000, cap=1e9)
    for k in range(400):
        c.batch(message(k, 25.0 * k, "word " * 20), answer(k, 25.0 * k))
    assert len(c.history) == 20 and len(c.handle.states["times"].value[0]) <= 3 and not c.handle.states["waiting"].exists() and not c.handle.states["flight"].exists()


def stub():
    """A factory made here, so that it travels to the workers by value."""

    def agent():
        def ask(question, history):
            if "slow" in question:
                raise TimeoutError
            if "hangs" in question:
                time.sleep(4)
            if "broken" in question:
                raise ValueError
            return {"answer": f"**{question}** after {len(history)}", "cost_usd": 0.4, "sources": [{"rfc": 5, "section": "9", "page": None}]}

        return ask

    return agent


def messages(spark, tmp_path):
    return spark.readStream.schema(service_module.MESSAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def test_service_over_streams(spark, tmp_path):
    """Three deliveries: guards, agent outcomes, a reset; each run goes on where the last one was."""
    options = {"limit": 2, "longest": 20, "cap": 0.7}
    first = [(1, 1, 0.0, "/start"), (1, 2, 1.0, "one"), (1, 3, 2.0, "slow"), (1, 4, 3.0, "three"), (2, 1, 1.0, "x" * 21), (2, 2, 2.0, "broken"), (None, 5, 2.0, "nobody")]
    second = [(1, 5, 30.0, "again"), (1, 6, 70.0, "later"), (3, 1, 71.0, "late"), (2, 3, 72.0, "/reset"), (2, 4, 73.0, "/other")]
    third = [(3, 2, 200.0, "too late")]
    for k, rows in enumerate((first, second, third)):
        spark.createDataFrame(rows, service_module.MESSAGES).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
        Service(spark, str(tmp_path / "data"), stub(), **options).run_available(messages(spark, tmp_path))
    service = Service(spark, str(tmp_path / "data"), stub(), **options)
    found = service.replies().collect()
    got = {(r.chat_id, r.seq): r.parts for r in found}
    says = service_module.REPLIES
    assert got[(1, 1)] == [says["onboarding"]] and got[(1, 4)] == [says["rate_limited"]] and got[(2, 1)] == [says["too_long"]]
    assert got[(1, 2)] == ["one after 0\n\nИсточники:\n— RFC 5 §9"] and got[(1, 3)] == [says["timeout"]] and got[(2, 2)] == [says["error"]]
    assert got[(1, 5)] == [says["rate_limited"]] and got[(1, 6)][0].startswith("later after 2") and got[(3, 1)][0].startswith("late after 0")
    assert got[(2, 3)] == [says["reset"]] and (2, 4) not in got and got[(3, 2)] == [says["over_budget"]] and len(got) == len(found) == 11
    assert {(r.chat_id, r.seq): r.cost_usd for r in service.spend().collect()} == {(1, 2): 0.4, (2, 2): 0.01, (1, 6): 0.4, (3, 1): 0.4}


def test_deadlines_are_enforced_and_calls_run_side_by_side():
    pdf = pd.DataFrame({"chat_id": range(4), "seq": range(4), "t": [10.0] * 4, "text": ["hangs", "fine", "hangs too", "broken"], "items": [[]] * 4})
    began = time.monotonic()
    made = pd.concat(list(service_module._asking(stub(), 0.5, 4)(iter([pdf]))))
    assert time.monotonic() - began < 2.0
    assert made["outcome"].tolist() == ["timeout", "ok", "timeout", "error"] and made["text"].iloc[1] == "**fine** after 0" and (made["t"] >= 10.0).all()


def test_a_batch_charged_again_changes_nothing(spark, tmp_path):
    service = Service(spark, str(tmp_path), stub(), 2, 20, 5.0)
    schema = "chat_id long, seq long, t double, kind string, text string, outcome string, cost_usd double, sources string"
    rows = [(1, 1, 1.0, "message", "a", None, None, None), (1, 1, 2.0, "answer", "b", "ok", 0.5, "[]"), (2, 1, 3.0, "message", "c", None, None, None), (2, 1, 4.0, "answer", None, "timeout", None, None), (3, 1, 5.0, "message", "d", None, None, None)]
    for batch in (0, 1, 1, 2):
        service._charge(spark.createDataFrame(rows, schema), batch)
    found = spark.read.parquet(f"{tmp_path}/events").where("kind = 'message'").orderBy("batch", "t").collect()
    assert [r.spent for r in found] == [0.0, 0.5, 0.5, 0.5, 1.0, 1.0, 1.0, 1.5, 1.5]
