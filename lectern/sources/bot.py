"""Chat messages from a bot server and replies to it, as a streaming data source.

    spark.dataSource.register(BotDataSource)
    messages = spark.readStream.format("lectern_bot").option("url", url).load()
    replies.writeStream.format("lectern_bot").option("url", url).option("checkpointLocation", folder).start()

The server numbers its messages from 1 on and keeps them until they are confirmed:

    GET  /latest                  -> {"latest": n}
    GET  /updates?from=a&to=b     -> [{"id", "chat_id", "t", "text"}, ...] with a <= id < b
    POST /confirm {"until": b}    messages before b are not asked for again
    POST /messages {"chat_id", "text"}, with the header Idempotency-Key: a message is sent once for each key

Reading: an offset is the number of the next message.  A batch is dealt out in ranges of at most ``rowsPerTask`` numbers, which
tasks fetch page by page; messages are confirmed only when Spark has committed their batch, so a batch that failed is read
again, and a query that was stopped goes on where it was.  Numbers that the server does not have are skipped.

Writing: rows (chat_id, seq, parts) are sent as one message a part, each under a key made of its row and part.  A call that
fails is tried again after growing pauses; if it fails for good the batch fails, and what Spark sends again the server knows
by its key.  A null or empty list of parts sends nothing.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

SCHEMA = "chat_id long, seq long, t double, text string"
ROWS_PER_TASK, PAGE = 10_000, 500
TRIES, PAUSE, TIMEOUT = 5, 0.2, 30.0


def call(url: str, body: dict | None = None, key: str | None = None, tries: int = TRIES, pause: float = PAUSE):
    """The JSON of a reply; connection errors and errors of the server's are tried again, those of the caller's are not."""
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Idempotency-Key": key} if key else {}))
    for k in range(1, tries + 1):
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as e:
            if e.code < 500 or k == tries:
                raise
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if k == tries:
                raise
        time.sleep(pause * 2 ** (k - 1))
    raise ValueError("tries must be at least 1")


@dataclass
class Range(InputPartition):
    start: int
    end: int


class BotReader(DataSourceStreamReader):
    def __init__(self, url: str, start: int, rows_per_task: int):
        self.url, self.start, self.rows_per_task = url, start, rows_per_task

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        return {"next": max(self.start, int(call(f"{self.url}/latest")["latest"]) + 1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["next"], end["next"]
        return [Range(k, min(b, k + self.rows_per_task)) for k in range(a, b, self.rows_per_task)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for a in range(partition.start, partition.end, PAGE):
            for u in call(f"{self.url}/updates?from={a}&to={min(partition.end, a + PAGE)}"):
                yield u["chat_id"], u["id"], float(u["t"]), u["text"]

    def commit(self, end: dict) -> None:
        call(f"{self.url}/confirm", {"until": end["next"]})


@dataclass
class Sent(WriterCommitMessage):
    n: int


class BotWriter(DataSourceStreamWriter):
    def __init__(self, url: str):
        self.url = url

    def write(self, iterator: Iterator) -> Sent:
        n = 0
        for row in iterator:
            for part, text in enumerate(row.parts or []):
                call(f"{self.url}/messages", {"chat_id": row.chat_id, "text": text}, f"{row.chat_id}-{row.seq}-{part}")
                n += 1
        return Sent(n)

    def commit(self, messages: list, batchId: int) -> None:
        """Everything has been sent by then."""

    def abort(self, messages: list, batchId: int) -> None:
        """What was sent stays sent; the batch comes again under the same keys."""


class BotDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_bot"

    def schema(self) -> str:
        return SCHEMA

    def _url(self) -> str:
        if "url" not in self.options:
            raise ValueError("the option url is missing")
        return self.options["url"].rstrip("/")

    def streamReader(self, schema) -> BotReader:
        return BotReader(self._url(), int(self.options.get("startingAt", 1)), int(self.options.get("rowsPerTask", ROWS_PER_TASK)))

    def streamWriter(self, schema, overwrite: bool) -> BotWriter:
        if not {"chat_id", "seq", "parts"} <= set(schema.names):
            raise ValueError("rows to send need chat_id, seq and parts")
        return BotWriter(self._url())
