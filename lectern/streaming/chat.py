"""A chat's guards, history and question in flight as keyed state.

Events are messages and the agent's answers, both (chat_id, seq, t, kind, ...).  Each chat is served one question at a time: a
question that passes the guards is asked at once, or waits until the one in flight has its answer.  Nothing is read back from
earlier batches, so a batch costs what its own events cost.

State of a chat, all of it bounded by parameters:
* ``times``: when questions were accepted, those within the window, at most ``limit``;
* ``history``: the last ``n`` turns and the open question;
* ``flight``: the question in flight, whether the chat was reset meanwhile, and until when its answer may come;
* ``waiting``: accepted questions behind it, at most ``limit`` a window;
* ``last``: the last message judged, since which one that comes again is known.

A timer ends a question whose answer is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.guards import WINDOW_SECONDS
from lectern.operators.sessions import FALLBACK_COST, LAST_TURNS, route_of
from lectern.streaming.guards import use_rocksdb

#: kind message or answer; ``spent`` is what the service had spent before a message; the rest belongs to answers.
EVENTS = "chat_id long, seq long, t double, kind string, text string, spent double, outcome string, cost_usd double, sources string"
#: kind ask (with the history), answer, timeout, error, the guard that refused, or the command.
TURNS = "chat_id long, seq long, t double, kind string, text string, items array<struct<role:string,text:string>>, cost_usd double, sources string"
#: The question's answer is taken for lost so many seconds after it was asked.
LOST_AFTER = 600.0


class ChatProcessor(StatefulProcessor):
    def __init__(self, limit: int, longest: int, cap: float, window: float = WINDOW_SECONDS, n: int = LAST_TURNS, lost_after: float = LOST_AFTER):
        self.limit, self.longest, self.cap, self.window, self.n, self.lost_after = limit, longest, cap, window, n, lost_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times_state = handle.getValueState("times", "times array<double>")
        self.history_state = handle.getListState("history", "role string, text string")
        self.flight_state = handle.getValueState("flight", "seq long, reset boolean, until long")
        self.waiting_state = handle.getListState("waiting", "seq long, text string")
        self.last_state = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load(key, timerValues)
        events = pd.concat(list(rows)).sort_values(["t", "seq", "kind"], ascending=[True, True, False])  # a message before its answer
        for e in events.itertuples():
            if e.kind == "message":
                self._message(e)
            elif self.flight is not None and self.flight[0] == e.seq:  # others are late, or come again
                self._settle(e.t, e.outcome, e)
        yield self._store()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load(key, timerValues)
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.flight is not None and self.flight[2] <= now:
            self._settle(now / 1000, "timeout", None)
        yield self._store()

    def close(self) -> None:
        pass

    # --- state ----------------------------------------------------------------------------------------------------

    def _load(self, key, timerValues) -> None:
        self.chat, self.now, self.out = key[0], timerValues.getCurrentProcessingTimeInMs(), []
        value = lambda state: state.get() if state.exists() else None
        rows = lambda state: [tuple(x) for x in state.get()] if state.exists() else []
        times, last, flight = value(self.times_state), value(self.last_state), value(self.flight_state)
        self.times, self.last = list(times[0]) if times else [], last[0] if last else None
        self.flight = list(flight) if flight else None
        self.history, self.waiting = rows(self.history_state), rows(self.waiting_state)

    def _store(self) -> pd.DataFrame:
        for state, there, put in (
            (self.times_state, self.times, lambda s: s.update((self.times,))),
            (self.history_state, self.history, lambda s: s.put(self.history)),
            (self.flight_state, self.flight, lambda s: s.update(tuple(self.flight))),
            (self.waiting_state, self.waiting, lambda s: s.put(self.waiting)),
            (self.last_state, self.last is not None, lambda s: s.update((self.last,))),
        ):
            if there:
                put(state)
            else:
                state.clear()
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if self.flight is not None:
            self.handle.registerTimer(max(self.flight[2], self.now + 1))
        made = pd.DataFrame(self.out, columns=[x.split()[0] for x in ("seq", "t", "kind", "text", "items", "cost_usd", "sources")])
        made.insert(0, "chat_id", self.chat)
        return made.astype({"chat_id": "int64", "seq": "int64", "t": "float64"})

    # --- events ---------------------------------------------------------------------------------------------------

    def _say(self, seq: int, t: float, kind: str, text: str | None = None, items=None, cost=None, sources: str | None = None) -> None:
        self.out.append((seq, t, kind, text, items, cost, sources))

    def _message(self, e) -> None:
        if self.last is not None and e.seq <= self.last:
            return
        self.last = e.seq
        text = e.text or ""
        route = route_of(text)
        if route == "reset":
            self.history = []
            if self.flight is not None:
                self.flight[1] = True
        if route != "question":
            if route != "ignored":
                self._say(e.seq, e.t, route)
            return
        self.times = [x for x in self.times if e.t - x < self.window]
        if self.times and len(self.times) >= self.limit:
            return self._say(e.seq, e.t, "rate_limited")
        self.times.append(e.t)
        if len(text) > self.longest:
            return self._say(e.seq, e.t, "too_long")
        if round(e.spent, 6) >= self.cap:
            return self._say(e.seq, e.t, "over_budget")
        self.waiting.append((e.seq, text))
        if self.flight is None:
            self._next(e.t)

    def _next(self, t: float) -> None:
        """Asks the first question that waits."""
        if not self.waiting:
            return
        seq, text = self.waiting.pop(0)
        before = self.history[-self.n :]
        self._say(seq, t, "ask", text, [{"role": a, "text": b} for a, b in before])
        self.history = [*before, ("user", text)]
        self.flight = [seq, False, self.now + int(self.lost_after * 1000)]

    def _settle(self, t: float, outcome: str, e) -> None:
        """Ends the question in flight: what is kept of it, what it cost, what is said, and who is next."""
        seq, reset, _ = self.flight
        self.flight = None
        if outcome == "timeout":
            self.history = self.history if reset else self.history[:-1]
            self._say(seq, t, "timeout")
        elif outcome == "error":
            self._say(seq, t, "error", cost=FALLBACK_COST)
        else:
            if not reset:
                self.history = [*self.history, ("assistant", e.text)][-self.n :]
            self._say(seq, t, "answer", e.text, cost=e.cost_usd, sources=e.sources)
        self._next(t)


def conversations(events: DataFrame, processor: ChatProcessor) -> DataFrame:
    """A stream of EVENTS -> TURNS; events without a chat have no one to answer and are left out."""
    use_rocksdb(events.sparkSession)
    return events.where("chat_id is not null").groupBy("chat_id").transformWithStateInPandas(processor, TURNS, "append", "processingTime")
