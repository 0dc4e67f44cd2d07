import random

import pytest

from lectern.sources.sessionstore import EVENTS, MemorySessions, SessionStore


def batches(seed, n=6, chats=7):
    r, seq = random.Random(seed), 0
    out = []
    for _ in range(n):
        rows = []
        for _ in range(r.randrange(0, 30)):
            seq += 1
            reset = r.random() < 0.1
            rows.append((r.choice([*range(chats), None]), seq, "reset" if reset else "append", None if reset else r.choice(["user", "assistant"]), None if reset else f"t{seq}"))
        out.append(rows)
    return out


def expected(rows, n, chats=None):
    held = {}
    for chat, _, op, role, text in rows:
        if op == "reset":
            held[chat] = []
        else:
            held[chat] = [*held.get(chat, []), (role, text)][-n:]
    return {c: h for c, h in held.items() if h and chat_in(c, chats) and c is not None}


def chat_in(c, chats):
    return chats is None or c in chats


def found(df):
    return {r.chat_id: [tuple(x) for x in r["items"]] for r in df.collect()}


def write(spark, store, rows, batch):
    store.append(spark.createDataFrame(rows, EVENTS).repartition(2), batch)


@pytest.mark.parametrize("folds", [set(), {2}, {0, 3, 5}])
def test_histories_are_those_of_all_events_whenever_the_log_is_folded(spark, tmp_path, folds):
    store, memory, so_far = SessionStore(spark, str(tmp_path), 4, 4), MemorySessions(spark, 4), []
    assert store.history().count() == 0 and store.fold() == -1
    for k, rows in enumerate(batches(3)):
        for s in (store, memory):
            write(spark, s, rows, k)
        if k in folds:
            assert store.fold() == k == memory.fold() and store.fold() == k
            write(spark, store, rows, k)  # sent again, behind the snapshot
        so_far += rows
        if k in (0, 2, 3, 5):
            for chats in (None, [1], [2, 5, 99]):
                assert found(store.history(chats)) == found(memory.history(chats)) == expected(so_far, 4, chats)


def test_a_snapshot_without_its_mark_is_not_read(spark, tmp_path):
    store, rows = SessionStore(spark, str(tmp_path), 4, 4), batches(5, 3)
    write(spark, store, rows[0], 0)
    store.fold()
    write(spark, store, rows[1], 1)
    spark.createDataFrame([(1, 999, "append", "user", "half", 0)], f"{EVENTS}, bucket int").write.partitionBy("bucket").parquet(str(tmp_path / "snapshots" / "upto=1"))  # a fold that ended there
    assert found(store.history()) == expected(rows[0] + rows[1], 4)
    assert store.fold() == 1 and found(store.history()) == expected(rows[0] + rows[1], 4)


def test_one_chat_costs_its_bucket_and_the_tail(spark, tmp_path):
    store, rows = SessionStore(spark, str(tmp_path), 4, 8), batches(7, 3, 40)
    for k in range(2):
        write(spark, store, rows[k], k)
    store.fold()
    write(spark, store, rows[2], 2)
    files = store.events([3]).inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in files if "bucket=" in f}) <= 8
    plan = store.events([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and "batch" in plan
