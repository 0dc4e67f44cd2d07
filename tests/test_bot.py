"""The bot source and sink against a server in this process."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from lectern.sources import bot
from lectern.streaming.service import Service


class Server:
    """Keeps messages until they are confirmed, and what was sent by key; fails the calls it is told to."""

    def __init__(self):
        self.updates, self.confirmed, self.sent, self.broken, self.calls, self.repeated = {}, 1, {}, [], [], 0
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def reply(self, value, code=200):
                raw = json.dumps(value).encode()
                self.send_response(code)
                self.end_headers()
                self.wfile.write(raw)

            def do_GET(self):
                url = urlparse(self.path)
                outer.calls.append(url.path)
                if url.path == "/latest":
                    return self.reply({"latest": max(outer.updates, default=0)})
                q = parse_qs(url.query)
                a, b = int(q["from"][0]), int(q["to"][0])
                if a < outer.confirmed:
                    return self.reply({"error": "confirmed already"}, 410)
                self.reply([outer.updates[k] for k in range(a, b) if k in outer.updates])

            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                if self.path == "/confirm":
                    outer.confirmed = max(outer.confirmed, body["until"])
                    return self.reply({})
                key = self.headers["Idempotency-Key"]
                if key in outer.broken:
                    outer.broken.remove(key)
                    return self.reply({"error": "try again"}, 503)
                outer.repeated += key in outer.sent
                outer.sent.setdefault(key, (body["chat_id"], body["text"]))
                self.reply({})

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def say(self, chat_id, text, t=0.0, skip=0):
        k = max(self.updates, default=0) + 1 + skip
        self.updates[k] = {"id": k, "chat_id": chat_id, "t": t, "text": text}


@pytest.fixture
def server(spark):
    spark.dataSource.register(bot.BotDataSource)
    s = Server()
    yield s
    s.http.shutdown()


def collect(spark, server, tmp_path, name="all", **options):
    """One run over what is there, into a folder of all runs."""
    stream = spark.readStream.format("lectern_bot").option("url", server.url).options(**options).load()
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}.cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    return sorted((r.seq, r.chat_id, r.t, r.text) for r in spark.read.schema(bot.SCHEMA).parquet(str(tmp_path / name)).collect())


def test_messages_are_read_once_in_ranges_and_confirmed_behind(spark, server, tmp_path):
    for k in range(23):
        server.say(k % 3, f"m{k}", float(k), skip=2 if k == 10 else 0)
    expected = [(u["id"], u["chat_id"], u["t"], u["text"]) for u in server.updates.values()]
    assert collect(spark, server, tmp_path, rowsPerTask="5") == expected
    assert server.calls.count("/updates") == 5  # 25 numbers, 5 a task
    server.say(9, None, 99.0)
    expected.append((26, 9, 99.0, None))
    assert collect(spark, server, tmp_path) == expected and server.confirmed >= 26  # the first batch is confirmed when the second begins
    assert collect(spark, server, tmp_path) == expected


def test_a_batch_that_failed_is_read_again(spark, server, tmp_path):
    for k in range(4):
        server.say(1, f"m{k}")
    broken = tmp_path / "broken"
    broken.mkdir()
    stream = spark.readStream.format("lectern_bot").option("url", server.url).load()

    def fail(batch, _):
        batch.count()
        raise ValueError("the sink is down")

    query = stream.writeStream.foreachBatch(fail).option("checkpointLocation", str(tmp_path / "all.cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="the sink is down"):
        query.awaitTermination(60)
    assert server.confirmed == 1
    server.say(1, "m4")
    assert [text for *_, text in collect(spark, server, tmp_path)][:4] == [f"m{k}" for k in range(4)]
    assert [text for *_, text in collect(spark, server, tmp_path)] == [f"m{k}" for k in range(5)]


def replies(spark, tmp_path, rows):
    spark.createDataFrame(rows, "chat_id long, seq long, parts array<string>").coalesce(1).write.mode("append").parquet(str(tmp_path / "replies"))


def send(spark, server, tmp_path):
    stream = spark.readStream.schema("chat_id long, seq long, parts array<string>").parquet(str(tmp_path / "replies"))
    query = stream.writeStream.format("lectern_bot").option("url", server.url).option("checkpointLocation", str(tmp_path / "send.cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)


def test_replies_are_sent_once_though_the_server_fails(spark, server, tmp_path, monkeypatch):
    replies(spark, tmp_path, [(1, 1, ["a", "b"]), (1, 2, None), (2, 3, []), (2, 4, ["c"])])
    server.broken = ["1-1-1", "2-4-0", "2-4-0"]  # tried again within the task
    send(spark, server, tmp_path)
    assert server.sent == {"1-1-0": (1, "a"), "1-1-1": (1, "b"), "2-4-0": (2, "c")} and server.repeated == 0
    replies(spark, tmp_path, [(3, 5, ["d"]), (3, 6, ["e"])])
    server.broken = ["3-6-0"] * bot.TRIES  # for good: the batch fails after its first message
    with pytest.raises(Exception, match="503"):
        send(spark, server, tmp_path)
    assert "3-5-0" in server.sent and "3-6-0" not in server.sent
    send(spark, server, tmp_path)
    assert server.sent["3-6-0"] == (3, "e") and server.repeated == 1 and len(server.sent) == 5
    send(spark, server, tmp_path)
    assert len(server.sent) == 5 and server.repeated == 1


def test_wrong_options_and_rows_are_told(spark, server, tmp_path):
    with pytest.raises(Exception, match="url is missing"):
        spark.readStream.format("lectern_bot").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start().awaitTermination(60)
    with pytest.raises(Exception, match="need chat_id, seq and parts"):
        spark.readStream.format("rate").load().writeStream.format("lectern_bot").option("url", server.url).option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start().awaitTermination(60)


def test_a_service_between_source_and_sink(spark, server, tmp_path):
    agent = lambda: lambda question, history: {"answer": f"{question} after {len(history)}", "cost_usd": 0.0, "sources": []}
    service = Service(spark, str(tmp_path / "data"), agent, 2, 20, 1.0)
    for texts in (["/start", "one", "two"], ["three"]):
        for text in texts:
            server.say(7, text, 100.0 if text == "three" else 1.0)
        service.run_available(spark.readStream.format("lectern_bot").option("url", server.url).load())
        assert service.reply().format("lectern_bot").option("url", server.url).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(text for _, text in server.sent.values()) == sorted(["ask a question about the documents", "one after 0", "two after 2", "three after 4"])
    assert service.turns().where(F.col("kind") == "ask").count() == 3
