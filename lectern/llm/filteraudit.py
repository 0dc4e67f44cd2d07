"""Filter interaction audit: what each of five filters removes, alone and in every order of the five.

Failure conditions, on whole texts (a null text counts as empty; words are runs other than ``[\\x20\\x09-\\x0D]``):
A under 100 words; B 100 * distinct words < 80 * words; C 100 * capitals A-Z > 10 * code points; D holds one of ``#$%&*|``;
E equal to the text of a row with a smaller id.

A row's conditions make a mask of five bits, and the counts of the 32 masks say all there is to say about any order.  So one
pass over the texts sets the bits, and only masks are counted:

* A task keeps chains of texts by their xxhash: of equal texts one is stored, with the least id.  A row that meets a smaller
  id is settled as a copy at once.  What is left, one entry a text and task, is routed by the fingerprint.
* Fingerprints arrive in order.  A chain of the texts that share one keeps each text once, with the least id; the entry
  with the larger id turns into settled copies.  So a text that a third of all rows share arrives once from every task,
  however many rows hold it, and memory holds the texts of one fingerprint.
* Settled rows carry no text.  They are joined with the labels by id, and ``combineByKey`` adds them up as one vector of
  mask counts a part.

Rows with a null id are no copies and make none.  Rows that share the least id of a text are no copies of each other.  Equal
ids with different texts are judged one by one; all of them get the labels of the id, of which any row with a 1 counts.  A
null language and an empty one are the same part; an empty table has no parts and no result.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import shuffle_width

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
MARKS, CAPITALS = b"#$%&*|", bytes(range(ord("A"), ord("Z") + 1))

#: A task hands its chains on and starts anew when their texts exceed so many bytes.
MOST_BYTES = 48 << 20
#: Words of longer texts are met one at a time and not as a list.
LONG_TEXT = 1 << 20

FACTS = "doc_id long, part string, mask int, n long"
REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: bytes, chars: int) -> int:
    """The mask of conditions A to D of a text of ``chars`` code points."""
    if len(text) <= LONG_TEXT:
        words = text.split()  # bytes split at the six ASCII blanks and nowhere else
        n, distinct = len(words), len(set(words))
    else:
        n, seen = 0, set()
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", text):
            n += 1
            seen.add(m[0])
        distinct = len(seen)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    marked = len(text.translate(None, MARKS)) < len(text)
    found = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * chars, marked)
    return sum(1 << k for k, x in enumerate(found) if x)


class _Chains:
    """Texts by fingerprint: of equal texts one, with the least id and the parts of the rows that have it."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.held = 0

    def add(self, fingerprint: int, text: bytes, mask: int | None, chars: int, doc_id: int, parts: dict[str, int]) -> Iterator[tuple]:
        """Takes rows of one text and id in; yields the rows (id, part, mask, n) that this settles as copies."""
        chain = self.chains.setdefault(fingerprint, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, failures(text, chars) if mask is None else mask, doc_id, parts])
            self.held += len(text) + 300
            return
        if doc_id < entry[2]:
            doc_id, parts, entry[2], entry[3] = entry[2], entry[3], doc_id, parts
        elif doc_id == entry[2]:
            for part, n in parts.items():
                entry[3][part] = entry[3].get(part, 0) + n
            return
        for part, n in parts.items():
            yield doc_id, part, entry[1] | COPY, n

    def drain(self) -> Iterator[tuple[int, list]]:
        for fingerprint, chain in self.chains.items():
            for entry in chain:
                yield fingerprint, entry
        self.chains, self.held = {}, 0


def _spread(doc_id: int | None) -> int:
    return (doc_id or 0) * 0x9E3779B97F4A7C15 >> 20 & 0x7FFFFFFF


def _route(most_bytes: int):
    """Rows of one task as (key, settled row) and (fingerprint, entry of a chain)."""

    def run(rows: Iterator) -> Iterator[tuple]:
        chains = _Chains()
        for doc_id, part, text, chars, fingerprint in rows:
            text = bytes(text)
            if doc_id is None:
                yield 0, (None, part, failures(text, chars), 1)
                continue
            for settled in chains.add(fingerprint, text, None, chars, doc_id, {part: 1}):
                yield _spread(settled[0]), settled
            if chains.held > most_bytes:
                yield from chains.drain()
        yield from chains.drain()

    return run


def _settle(rows: Iterator) -> Iterator[tuple]:
    """Entries in the order of their fingerprints, and settled rows between them, as settled rows."""
    now, chains = None, _Chains()

    def kept() -> Iterator[tuple]:
        for _, (_, mask, doc_id, parts) in chains.drain():
            for part, n in parts.items():
                yield doc_id, part, mask, n

    for key, value in rows:
        if isinstance(value, tuple):
            yield value
            continue
        if key != now:
            yield from kept()
            now = key
        text, mask, doc_id, parts = value
        yield from chains.add(key, text, mask, 0, doc_id, parts)
    yield from kept()


def filter_masks(docs: DataFrame, fingerprint: Column | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """How many rows have each (doc_id, part, mask).  ``docs`` has doc_id, text and lang.

    ``fingerprint`` may be any long that is equal for equal texts (the column is ``text``); xxhash64 by default.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.xxhash64("text") if fingerprint is None else fingerprint
    texts = rows.select("doc_id", "part", F.col("text").cast("binary"), F.length("text"), key).rdd
    routed = texts.mapPartitions(_route(most_bytes)).repartitionAndSortWithinPartitions(max(texts.getNumPartitions(), shuffle_width(spark)), lambda k: k)
    settled = spark.createDataFrame(routed.mapPartitions(_settle), FACTS, verifySchema=False)
    return settled.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def mask_counts(facts: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts): a row of rows, good rows and toxic rows for each mask.  ``labels`` has doc_id, quality and toxic."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(f"_{c}")
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(one("quality"), one("toxic"))
    named = facts.join(known, facts["doc_id"] == known["_id"], "left").select("part", "mask", "n", F.coalesce("_quality", F.lit(0)), F.coalesce("_toxic", F.lit(0)))

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[mask] += (n, n * good, n * toxic)
        return counts

    def first(row: tuple) -> np.ndarray:
        return add(np.zeros((MASKS, 3), dtype=np.int64), row)

    return named.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(first, add, np.add, shuffle_width(facts.sparkSession))


def orders(counts: np.ndarray) -> Iterator[tuple]:
    """The report of one part: a row for each order and step."""
    masks = np.arange(MASKS)
    fails = [masks >> k & 1 == 1 for k in range(len(FILTERS))]
    # gone[before][k]: what filter k removes after the filters whose bits are in before
    gone = [[counts[fails[k] & (masks & before == 0)].sum(axis=0).tolist() for k in range(len(FILTERS))] for before in range(MASKS)]
    failing = [int(counts[f, 0].sum()) for f in fails]
    alone = [int(counts[1 << k, 0]) for k in range(len(FILTERS))]
    steps, shapley = [], [0] * len(FILTERS)
    for order in permutations(range(len(FILTERS))):
        kept, before = int(counts[:, 0].sum()), 0
        for step, k in enumerate(order, 1):
            removed, good, toxic = gone[before][k]
            kept -= removed
            before |= 1 << k
            shapley[k] += removed
            steps.append((order, step, k, kept, removed, failing[k] - removed, alone[k], good, toxic))
    for order, step, k, *rest in steps:
        yield "".join(FILTERS[x] for x in order), step, *rest, shapley[k]


def audit(docs: DataFrame, labels: DataFrame, fingerprint: Column | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row for each part (language), order of the filters and step; see the module for what it holds."""
    counts = mask_counts(filter_masks(docs, fingerprint, most_bytes), labels)
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda x: [(x[0], *row) for row in orders(x[1])]), REPORT, verifySchema=False)
