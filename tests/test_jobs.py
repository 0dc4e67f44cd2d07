import datetime
import json
import os
import random
import subprocess
import sys
from collections import Counter

import pytest

from jobs import chat_ledger, ingest_passages
from jobs.common import load_config
from jobs.queries import SQL
from lectern.operators.chunking import window_spans
from tests.conftest import ROOT

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, start int, `a.b` string"


def add_file(spark, folder, name, rows, at):
    """One Parquet file of documents, with a time of its own."""
    spark.createDataFrame([(*r, None, None, "x") for r in rows], DOCS).coalesce(1).write.parquet(f"{folder}-{name}")
    os.makedirs(folder, exist_ok=True)
    part = next(x for x in os.listdir(f"{folder}-{name}") if x.startswith("part-"))
    os.rename(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")
    os.utime(f"{folder}/{name}.parquet", (at, at))


def expected(rows, window=60, overlap=12):
    return Counter((i, s, a, b, t[a:b]) for i, t, _, s in rows if t for a, b in window_spans(t, window, overlap))


def found(rows):
    return Counter((r.doc_id, r.source, r.start, r.end, r.text) for r in rows.collect())


FIRST = [(1, "one two three " * 30, "en", "a"), (2, None, "en", "a"), (3, " \n", None, None), (4, "", "de", "b"), (None, "no id at all " * 9, "en", None), (5, "x" * 300, "en", "b"), (6, "same row", "en", "b"), (6, "same row", "en", "b")]
SECOND = [(7, "seven is new " * 20, "fr", "c"), (1, "one is revised", "en", "b"), (None, "nor has this", "en", "a")]


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    config = ingest_passages.Config(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), 60, 12)
    add_file(spark, config.input, "one", FIRST, 1_700_000_000)
    assert ingest_passages.run(spark, config) == sum(expected(FIRST).values())
    assert found(ingest_passages.read_output(spark, config.output)) == expected(FIRST)
    assert ingest_passages.run(spark, config) == 0
    add_file(spark, config.input, "two", SECOND, 1_700_000_100)
    assert ingest_passages.run(spark, config) == sum(expected(SECOND).values())
    for _ in range(2):
        whole = ingest_passages.read_output(spark, config.output)
        assert found(whole) == expected(FIRST) + expected(SECOND)
        assert found(ingest_passages.current(whole)) == expected([r for r in FIRST if r[0] != 1]) + expected(SECOND)
        assert ingest_passages.run(spark, config) == 0
    assert {x for x in os.listdir(config.output) if x.startswith("source=")} == {"source=a", "source=b", "source=c", "source=__HIVE_DEFAULT_PARTITION__"}


def test_a_run_that_ended_before_its_commit_doubles_nothing(spark, tmp_path):
    config = ingest_passages.Config(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), 60, 12)
    add_file(spark, config.input, "one", FIRST, 1_700_000_000)
    ingest_passages.run(spark, config)
    for name in ("0", ".0.crc"):
        (tmp_path / "mark" / "commits" / name).unlink(missing_ok=True)
    add_file(spark, config.input, "two", SECOND, 1_700_000_100)
    ingest_passages.run(spark, config)
    assert found(ingest_passages.read_output(spark, config.output)) == expected(FIRST) + expected(SECOND)


def test_ingest_of_an_empty_file_and_of_none(spark, tmp_path):
    config = ingest_passages.Config(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), 60, 12)
    os.makedirs(config.input)
    assert ingest_passages.run(spark, config) == 0 and ingest_passages.read_output(spark, config.output).count() == 0
    add_file(spark, config.input, "none", [], 1_700_000_000)
    assert ingest_passages.run(spark, config) == 0 and ingest_passages.read_output(spark, config.output).count() == 0


def judged(events, config):
    """The service's guards, message by message."""
    times, spent, out = {}, 0.0, []
    for chat, seq, t, text, cost in sorted(events, key=lambda e: (e[2] is not None, e[2], e[0] is not None, e[0], e[1] is not None, e[1])):
        s = float("-inf") if t is None else t.timestamp()
        held = times.setdefault(chat, [])
        held[:] = [x for x in held if not s - x >= config.window_seconds]
        verdict = "rate_limited" if held and len(held) >= config.limit else None
        if verdict is None:
            held.append(s)
            verdict = "too_long" if text is not None and len(text) > config.longest else "ok" if round(spent, 6) < config.cap else "over_budget"
            spent += (cost or 0.0) if verdict in ("ok", "over_budget") else 0.0
        out.append((chat, t and t.date(), verdict, (cost or 0.0) if verdict == "ok" else 0.0))
    days = {}
    for chat, day, verdict, cost in out:
        row = days.setdefault((chat, day), [Counter(), 0.0])
        row[0][verdict] += 1
        row[1] += cost
    return {k: (sum(n.values()), *(n[v] for v in chat_ledger.VERDICTS), round(c, 6), round(sum(d[1] for (chat, day), d in days.items() if chat == k[0] and (day is None or (k[1] is not None and day <= k[1]))), 6)) for k, (n, c) in days.items()}


def stamp(day, second):
    return datetime.datetime(2024, 3, day, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=second)


def chat_events(seed, days, n):
    r = random.Random(seed)
    return [(r.choice([None, 1, 2, 3, 4]), 1000 * seed + k, None if seed == 1 and k % 40 == 0 else stamp(r.choice(days), r.choice([0, 1, 5, 30, 55, 86399, r.randrange(86400)])), r.choice([None, "", "short", "much too long a text"]), r.choice([None, 0.0, 0.25, 0.5])) for k in range(n)]


def write_events(spark, path, events):
    rows = [(seq, t, chat, text, cost, "x") for chat, seq, t, text, cost in events]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, props string, value double, day string").write.mode("append").parquet(path)


def test_ledger_equals_judging_message_by_message_and_keeps_other_days(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    config = chat_ledger.Config(path, out, 2, 10, 30.0, 60.0)
    old = chat_events(1, [1, 2], 300)
    write_events(spark, path, old)
    rows = lambda: {(r.chat_id, r.day): tuple(r)[1:-1] for r in chat_ledger.read_output(spark, out).collect()}
    for _ in range(2):
        chat_ledger.run(spark, config)
        assert rows() == judged(old, config)
    new = chat_events(2, [2, 3], 200)
    write_events(spark, path, new)
    for _ in range(2):
        chat_ledger.run(spark, chat_ledger.Config(path, out, 2, 10, 30.0, 60.0, since="2024-03-02", until="2024-03-03"))
        both, second = judged(old + new, config), datetime.date(2024, 3, 2)
        assert rows() == {k: v for k, v in judged(old, config).items() if k[1] != second} | {k: v for k, v in both.items() if k[1] == second}
    chat_ledger.run(spark, config)
    assert rows() == both
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_ledger_of_an_empty_table(spark, tmp_path):
    write_events(spark, str(tmp_path / "in"), [])
    chat_ledger.run(spark, chat_ledger.Config(str(tmp_path / "in"), str(tmp_path / "out"), 2, 10, 30.0))
    assert chat_ledger.read_output(spark, str(tmp_path / "out")).count() == 0


def test_config_files_and_options(tmp_path):
    for job, kind in (("ingest_passages", ingest_passages.Config), ("chat_ledger", chat_ledger.Config)):
        path = f"{ROOT}/jobs/{job}.json"
        shipped = load_config(kind, ["--config", path], "")
        assert shipped == kind(**json.load(open(path)))
        assert load_config(kind, ["--config", path, "--input", "s3a://b/x"], "").input == "s3a://b/x"
    (tmp_path / "c.json").write_text('{"input": "a", "output": "b", "checkpoint": "c", "windows": 3}')
    with pytest.raises(ValueError, match="unknown fields: windows"):
        load_config(ingest_passages.Config, ["--config", str(tmp_path / "c.json")], "")
    with pytest.raises(ValueError, match="missing fields: output, checkpoint"):
        load_config(ingest_passages.Config, ["--input", "a"], "")
    with pytest.raises(ValueError, match="overlap"):
        load_config(ingest_passages.Config, ["--input", "a", "--output", "b", "--checkpoint", "c", "--window", "10"], "")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")
def test_command_line(tmp_path):
    """In a process of its own, which makes and stops the session."""
    env = os.environ | {"PYTHONPATH": ROOT}
    arguments = ["--input", f"{DATA}/events.parquet", "--output", str(tmp_path / "out"), "--limit", "2", "--longest", "9", "--cap", "20000"]
    done = subprocess.run([sys.executable, "-m", "jobs.chat_ledger", *arguments], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "chat_ledger INFO read 1000 messages" in done.stderr and any(x.startswith("day=") for x in os.listdir(tmp_path / "out"))


def test_both_jobs_have_sql():
    assert len(SQL) == 2
