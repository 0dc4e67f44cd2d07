"""Benchmark decontamination: a BM25 index of test items, block-max WAND for every training passage, then verification.

Items are cut into question and answer and indexed: postings of terms with BM25 impacts, divided by the item's own score
so that one threshold fits all items, in blocks of neighbouring items with the greatest impact of each block.  Every
document is read as overlapping passages long enough to hold any item; each passage is a query that retrieves all items
at or above the threshold.

The index rests on every task (its size is bounded by handling items in blocks of ``MOST_ITEMS``; each block is one
pass over the documents).  Document frequencies and lengths are those of all items, so a score does not depend on the
number of passes.  Frequent terms are non-essential in the sense of MaxScore: what they can add to any item of a block
is a constant, so only essential terms are looked at to bound passages against blocks of items, for all passages of a
slice at once.  Where that constant alone would reach the threshold, the rarest of an item's frequent terms are
essential for its block, so no item is out of reach of its own terms.  Equal items are indexed once.  Passages that stay
in question run through block-max WAND over their posting lists within all blocks left open.

A pair counts as a leak if five-word shingles of the question and the words of the answer are found in the passage to
the shares asked for.  Punctuation and case are ignored.

Edge cases: null and empty texts and items match nothing; texts are used whole; items with fewer than ``LEAST_WORDS``
words match texts that consist of the same words and nothing else, with score 1; an item without words before its answer
is all question; equal items are all reported; rows that share an id give one row an item,
with the best values; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textkit
from lectern.llm.runtime import arrow_batches, cut

K1, B = 1.2, 0.75
THRESHOLD = 0.6
QUESTION_SHARE, ANSWER_SHARE = 0.8, 0.8
SHINGLE = 5
LEAST_WORDS = 8
ITEM_BLOCK = 4
MOST_ITEMS = 20_000
#: Terms in more than this share of the items are non-essential.
COMMON_SHARE = 0.05
_ANSWER = re.compile(r"(?im)^\s*(?:answer|a)\s*[:.)]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: at an answer mark, else before the last sentence of three words or more, else at 3/4."""
    marks = list(_ANSWER.finditer(text))
    if marks and marks[-1].start() > 0:
        return text[: marks[-1].start()], text[marks[-1].end() :]
    cuts = [m.end() for m in _SENTENCE.finditer(text)]
    for c in reversed(cuts):
        if len(text[c:].split()) >= 3 and len(text[:c].split()) >= LEAST_WORDS - 3:
            return text[:c], text[c:]
    words = text.split()
    k = max(1, len(words) * 3 // 4)
    return " ".join(words[:k]), " ".join(words[k:])


def text_hashes(texts: list[str]) -> list[np.ndarray]:
    data, offsets = textkit.buffers(pa.array(texts, pa.string()))
    starts, ends, bounds = textkit.words(data, offsets, bare=True)
    hashes = textkit.word_hashes(data, starts, ends)
    return [hashes[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    return textkit.shingles(words, np.array([0, len(words)]), width)[0]


@dataclass
class Index:
    """Postings by term: items (rising) and impacts; by term and block of items the greatest impact, and the essential of these.

    An item is a distinct text; ``ids`` holds the item ids of each.
    """

    ids: list[np.ndarray]
    terms: np.ndarray
    first: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_first: np.ndarray
    blocks: np.ndarray
    block_most: np.ndarray
    open_first: np.ndarray
    open_blocks: np.ndarray
    open_most: np.ndarray
    slack: np.ndarray
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    longest: int
    short: dict[bytes, np.ndarray]  # by their words, the ids of items too short to be searched for

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        return self.items[self.first[term] : self.first[term + 1]], self.impacts[self.first[term] : self.first[term + 1]]


def item_words(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The words of question and answer of each item."""
    parts = [split_item(t or "") for t in texts]
    pairs = zip(text_hashes([q for q, _ in parts]), text_hashes([a for _, a in parts]), strict=True)
    return [(q, a) if len(q) else (a, q) for q, a in pairs]


@dataclass
class Statistics:
    """Of all distinct items that are searched for: how many, their mean and greatest length, and in how many a term occurs."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray  # sorted
    df: np.ndarray


def build_index(rows: list[tuple[int, str]], threshold: float = THRESHOLD, known: Statistics | None = None) -> Index | None:
    """From (item id, text), for searches at ``threshold`` or above; None if no item has words.

    ``known`` are the statistics of all items if these are some of them only.
    """
    words = item_words([t for _, t in rows])
    equal: dict[tuple[bytes, bytes], list[int]] = {}
    short: dict[bytes, list[int]] = {}
    for i, (q, a) in enumerate(words):
        if len(q) + len(a) >= LEAST_WORDS:
            equal.setdefault((q.tobytes(), a.tobytes()), []).append(i)
        elif len(q):
            short.setdefault(q.tobytes() + a.tobytes(), []).append(i)
    named = lambda same: np.unique(np.array([rows[i][0] for i in same], np.int64))
    brief = {k: named(same) for k, same in short.items()}
    if not equal:
        none, counts = np.zeros(0, np.int64), np.zeros(1, np.int64)
        return Index([], none.view(np.uint64), counts, none, none.astype(float), counts, none, none.astype(float), counts, none, none.astype(float), none.astype(float), [], [], LEAST_WORDS, brief) if brief else None
    keep = [same[0] for same in equal.values()]
    questions, answers = [words[i][0] for i in keep], [words[i][1] for i in keep]
    whole = [np.concatenate([q, a]) for q, a in zip(questions, answers, strict=True)]
    length = np.array([len(x) for x in whole], float)
    found = [np.unique(x, return_counts=True) for x in whole]
    owner = np.repeat(np.arange(len(whole)), [len(t) for t, _ in found])
    tf = np.concatenate([c for _, c in found]).astype(float)
    terms, at = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
    if known is None:
        known = Statistics(len(whole), float(length.mean()), int(length.max()), terms, np.bincount(at, minlength=len(terms)))
    df = known.df[np.searchsorted(known.terms, terms)]
    idf = np.log(1 + (known.n - df + 0.5) / (df + 0.5))
    impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / known.mean))
    impact /= np.bincount(owner, impact, minlength=len(whole))[owner]
    order = np.lexsort((owner, at))
    at, items, impact = at[order], owner[order], impact[order]
    first = np.searchsorted(at, np.arange(len(terms) + 1))
    block = items // ITEM_BLOCK
    begins = np.concatenate([[True], (at[1:] != at[:-1]) | (block[1:] != block[:-1])])
    edge, entry = np.flatnonzero(begins), np.cumsum(begins) - 1
    essential = df[at[edge]] <= max(2, COMMON_SHARE * known.n)

    def common() -> np.ndarray:
        rest = ~essential[entry]
        return np.bincount(items[rest], impact[rest], minlength=len(whole))

    # the rarest frequent terms of an item become essential in its block until the others fall short of the threshold
    left, by_item = common(), np.lexsort((df[at], items))
    bounds = np.searchsorted(items[by_item], np.arange(len(whole) + 1))
    for item in np.flatnonzero(left >= threshold - 1e-6):
        mine = by_item[bounds[item] : bounds[item + 1]]
        mine = mine[~essential[entry[mine]]]
        above = np.count_nonzero(impact[mine].sum() - np.cumsum(impact[mine]) >= threshold - 1e-6)
        essential[entry[mine[: above + 1]]] = True
    slack = np.maximum.reduceat(common(), np.arange(0, len(whole), ITEM_BLOCK))
    most = np.maximum.reduceat(impact, edge)
    return Index(
        [named(same) for same in equal.values()], terms, first, items, impact,
        np.searchsorted(at[edge], np.arange(len(terms) + 1)), block[edge], most,
        np.searchsorted(at[edge][essential], np.arange(len(terms) + 1)), block[edge][essential], most[essential], slack, questions, answers, known.longest, brief,
    )


def block_max_wand(index: Index, terms: np.ndarray, threshold: float, within: np.ndarray | None = None, looked_at: list | None = None) -> list[tuple[int, float]]:
    """All items whose score for ``terms`` (distinct) is at least ``threshold``: (item, score).

    ``within``, sorted numbers of blocks, limits the search; ``looked_at`` gets the postings that were scored.
    Cursors are kept in order of their items.  The pivot is where the lists' greatest impacts first reach the
    threshold; the greatest impacts of the pivot's block are tried before anything is scored, and if they fall short
    the cursors leap to the next block.
    """
    threshold -= 1e-9
    lists, used = [], []
    for t in terms:
        items, impacts = index.postings(t)
        if within is not None and not len(within):
            break
        if within is not None:
            block = items // ITEM_BLOCK
            place = within.searchsorted(block)
            inside = within[np.minimum(place, len(within) - 1)] == block
            items, impacts = items[inside], impacts[inside]
        if len(items):
            lists.append((items, impacts))
            used.append(t)
    tops = [float(w.max()) for _, w in lists]
    spans = [(index.blocks[index.block_first[t] : index.block_first[t + 1]], index.block_most[index.block_first[t] : index.block_first[t + 1]]) for t in used]
    at = [0] * len(lists)
    heap = [(int(items[0]), k) for k, (items, _) in enumerate(lists)]
    heapq.heapify(heap)
    out = []

    def leap(k: int, item: int) -> None:
        at[k] += int(lists[k][0][at[k] :].searchsorted(item))
        if at[k] < len(lists[k][0]):
            heapq.heappush(heap, (int(lists[k][0][at[k]]), k))

    while heap:
        order, bound = [], 0.0
        while heap and bound < threshold:
            item, k = heapq.heappop(heap)
            order.append((item, k))
            bound += tops[k]
        if bound < threshold:
            break
        pivot = order[-1][0]
        while heap and heap[0][0] == pivot:
            order.append(heapq.heappop(heap))
        block, near = pivot // ITEM_BLOCK, 0.0
        for _, k in order:
            j = int(spans[k][0].searchsorted(block))
            if j < len(spans[k][0]) and spans[k][0][j] == block:
                near += float(spans[k][1][j])
        if near < threshold:
            # no item up to the next block, or to where another list begins, can reach the threshold
            target = min((block + 1) * ITEM_BLOCK, heap[0][0] if heap else 1 << 62)
            for _, k in order:
                leap(k, max(target, pivot + 1) if heap and heap[0][0] > pivot else (block + 1) * ITEM_BLOCK)
            continue
        score = 0.0
        for item, k in order:
            if item < pivot:
                at[k] += int(lists[k][0][at[k] :].searchsorted(pivot))
            if at[k] < len(lists[k][0]) and lists[k][0][at[k]] == pivot:
                score += float(lists[k][1][at[k]])
                if looked_at is not None:
                    looked_at.append((pivot, k))
        if score >= threshold:
            out.append((pivot, score))
        for _, k in order:
            leap(k, pivot + 1)
    return out


class Searcher:
    def __init__(self, index: Index, threshold: float, question_share: float, answer_share: float):
        self.index, self.threshold = index, threshold
        self.shares = question_share, answer_share
        self.step = max(16, -(-index.longest // 2))
        self.questions = [np.unique(_runs(q, SHINGLE)) for q in index.questions]
        self.answers = [np.unique(a) for a in index.answers]

    def passages(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, first word, end, block) of passages and the blocks of items that they may still match.

        A passage is three steps of words; one begins at every step.
        """
        index, step = self.index, self.step
        count = np.diff(bounds)
        chunks = -(-count // step)
        chunk_first = np.concatenate([[0], np.cumsum(chunks)])
        at = np.searchsorted(index.terms, hashes)
        at[at == len(index.terms)] = 0
        hit = (index.terms[at] == hashes) & (np.diff(index.open_first)[at] > 0)
        place = np.flatnonzero(hit)
        if not len(place):
            return ()
        text = np.searchsorted(bounds, place, side="right") - 1
        chunk = chunk_first[text] + (place - bounds[text]) // step
        key = np.unique((chunk.astype(np.uint64) << np.uint64(32)) | at[place].astype(np.uint64))
        chunk, term = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        many = np.diff(index.open_first)[term]
        owner = np.repeat(np.arange(len(term)), many)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + index.open_first[term][owner]
        blocks = len(index.slack)
        key = chunk[owner] * blocks + index.open_blocks[inner]
        order = np.argsort(key, kind="stable")
        key, most = key[order], index.open_most[inner][order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, most = key[edge], np.add.reduceat(most, edge)
        text = np.searchsorted(chunk_first, key // blocks, side="right") - 1
        spread, value = [], []
        for back in range(3):  # the passages that begin at this chunk and at the two before it
            good = key // blocks - back >= chunk_first[text]
            spread.append((key - back * blocks)[good])
            value.append(most[good])
        key, value = np.concatenate(spread), np.concatenate(value)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, value = key[edge], np.add.reduceat(value, edge)
        open_ = value + index.slack[key % blocks] >= self.threshold - 1e-9
        start = key[open_] // blocks
        text = np.searchsorted(chunk_first, start, side="right") - 1
        first = bounds[text] + (start - chunk_first[text]) * step
        return text, first, np.minimum(first + 3 * step, bounds[text + 1]), key[open_] % blocks

    def search(self, column: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question share, answer share) of the leaks, the best of each pair."""
        data, offsets = textkit.buffers(column)
        starts, ends, bounds = textkit.words(data, offsets, bare=True)
        hashes = textkit.word_hashes(data, starts, ends)
        out = []
        if self.index.short:
            for text in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < LEAST_WORDS)):
                ids = self.index.short.get(hashes[bounds[text] : bounds[text + 1]].tobytes(), ())
                out += [(int(text), int(k), 1.0, 1.0, 1.0) for k in ids]
        found = self.passages(hashes, bounds) if len(self.index.ids) else ()
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        # passages come in order of their first word, each with its blocks in order
        edge = np.flatnonzero(np.concatenate([[True], found[1][1:] != found[1][:-1]])) if found and len(found[1]) else np.zeros(0, np.int64)
        for e, f in zip(edge, np.append(edge[1:], len(found[1]) if found else 0), strict=True) if len(edge) else ():
            text, a, b = found[0][e], found[1][e], found[2][e]
            part, runs = hashes[a:b], None
            distinct = np.unique(part)
            at = np.searchsorted(self.index.terms, distinct)
            at[at == len(self.index.terms)] = 0
            terms = at[self.index.terms[at] == distinct]
            for item, score in block_max_wand(self.index, terms, self.threshold, found[3][e:f]):
                runs = np.unique(_runs(part, SHINGLE)) if runs is None else runs
                q, w = self.questions[item], self.answers[item]
                wide = runs if len(self.index.questions[item]) >= SHINGLE else _runs(part, len(self.index.questions[item]))
                share = float(np.isin(q, wide).mean()), float(np.isin(w, distinct).mean()) if len(w) else 1.0
                if share[0] >= self.shares[0] and share[1] >= self.shares[1]:
                    key, value = (int(text), item), (*share, score)
                    best[key] = max(best.get(key, value), value)
        return out + [(t, int(k), v[2], v[0], v[1]) for (t, i), v in best.items() for k in self.index.ids[i]]


def _prepared(batches):
    """(item_id, text) -> with a key of its words, their number and, for one row a key, the distinct words."""
    for batch in batches:
        words = [np.concatenate(w) for w in item_words(batch.column(1).to_pylist())]
        key = [int(textkit.shingles(w, np.array([0, len(w)]), len(w))[0][0].view(np.int64)) if len(w) else 0 for w in words]
        terms = pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int64()), pa.array([len(w) for w in words], pa.int32()), terms], names=["item_id", "text", "key", "length", "terms"])


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question_share: float = QUESTION_SHARE, answer_share: float = ANSWER_SHARE) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of all leaks of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    usable = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    passes = max(1, math.ceil(usable.count() / (MOST_ITEMS // 2)))
    if passes > 1:  # the statistics of all items; those of one pass are its own
        usable = cut(usable.mapInArrow(_prepared, "item_id long, text string, key long, length int, terms array<long>"))
        once = usable.where(F.col("length") >= LEAST_WORDS).dropDuplicates(["key"])
        size = once.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest")).first()
        frequency = cut(once.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
    found = spark.createDataFrame([], schema)
    source = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for k in range(passes):
        # equal items have equal keys and so come in the same pass
        part, known = usable, None
        if passes > 1:
            part = usable.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == k)
            mine = frequency.join(part.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").toPandas()
            order = np.argsort(mine["term"].to_numpy().view(np.uint64))
            known = Statistics(size["n"], size["mean"] or 1.0, size["longest"] or 0, mine["term"].to_numpy().view(np.uint64)[order], mine["df"].to_numpy()[order])
        part = part.select("item_id", "text").orderBy("item_id", "text").collect()
        index = build_index([(r["item_id"], r["text"]) for r in part], threshold, known)
        if index is None:
            continue
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            searcher = Searcher(shared.value, threshold, question_share, answer_share)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for i, j in textkit.slices(textkit.buffers(batch.column(1))[1]):
                    leaks = searcher.search(batch.column(1).slice(i, j - i))
                    if leaks:
                        columns = [[ids[i + x[0]] for x in leaks], *[[x[m] for x in leaks] for m in range(1, 5)]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()], strict=True)], names=names)

        found = found.unionByName(source.mapInArrow(run, schema))
    best = F.max(F.struct("question_overlap", "answer_overlap", "score")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.question_overlap", "best.answer_overlap")


def drop_leaking(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; rows with a null id are judged like any other."""
    leaking = cut(find_leaks(docs, items).select(F.col("doc_id").alias("_leak_id")).distinct())
    return docs.join(leaking, docs["doc_id"].cast("long").eqNullSafe(F.col("_leak_id")), "left_anti")
