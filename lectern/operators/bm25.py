"""BM25 over a corpus for all queries at once.

The statistics of the query terms come from one pass over the corpus and travel, with the queries, to the tasks of a
second one, which scores texts in batches and keeps the best of each query: what is shuffled is k rows a query and task,
not the pairs of queries and documents that share a word.  Queries with more terms than ``MOST_QUERY_TERMS`` together
take the way by postings joined on terms.  Scores are ranked after rounding to six decimals, then by id, so that the
order of summation does not show.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.functions.text import tokens
from lectern.operators.batches import runs, text_parts
from lectern.operators.topk import Best

K1, B = 1.5, 0.75
#: Distinct query terms up to this number are broadcast.
MOST_BROADCAST_TERMS = 200_000
#: Pairs of query and term up to this number are sent to the tasks.
MOST_QUERY_TERMS = 1_000_000
#: Scores of a text's word for a query that a task adds up at once, but for those of a single text.
PAIRS = 500_000
_WORD = re.compile("[a-z0-9]+")


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@dataclass(frozen=True)
class Bm25Index:
    """postings (term, id, tf, length), df (term, df) and stats (n, avg_length), restricted to the terms asked for."""

    postings: DataFrame
    df: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, corpus: DataFrame, terms: DataFrame | None = None) -> Bm25Index:
        """From (id, text); ``terms`` (term) limits what is kept, never the statistics."""
        cut = corpus.select("id", tokens(F.col("text")).alias("ts")).withColumn("length", F.coalesce(F.size("ts"), F.lit(0)))
        stats = cut.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"))
        rows = cut.select("id", "length", F.explode("ts").alias("term"))
        if terms is not None:
            rows = rows.join(small(terms.select("term").distinct(), MOST_BROADCAST_TERMS), "term", "left_semi")
        postings = rows.groupBy("term", "id", "length").agg(F.count("*").alias("tf"))
        return cls(postings, postings.groupBy("term").agg(F.count("*").alias("df")), stats)

    def scores(self, queries: DataFrame) -> DataFrame:
        """(qid, text) -> (qid, id, score) of positive scores; a term repeated in a query counts again."""
        asked = query_terms(queries)
        n, avg = F.col("n"), F.col("avg_length")
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = self.df.join(F.broadcast(self.stats)).select("term", idf.alias("idf"), "avg_length")
        norm = K1 * (1 - B + B * F.col("length") / avg)
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
        met = self.postings.join(small(asked, MOST_BROADCAST_TERMS), "term").join(weights, "term")
        return met.groupBy("qid", "id").agg(F.sum(part).alias("score")).where("score > 0")


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def ranked(scores: DataFrame, k: int | None = None, by: str = "score", id_column: str = "id") -> DataFrame:
    """Adds rank within qid by rounded score, then id; the first k of each."""
    order = Window.partitionBy("qid").orderBy(F.round(by, 6).desc(), F.col(id_column))
    out = scores.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def _codes(text: str | None, terms: dict[str, int]) -> tuple[int, np.ndarray]:
    """Length in tokens of a lower-cased text, and the numbers of those that queries ask for."""
    words = _WORD.findall(text or "")
    return len(words), np.array([terms[w] for w in words if w in terms], np.int64)


def _statistics(texts: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """(documents, tokens, documents with each term) in one pass."""

    def run(batches):
        terms = shared.value
        df, n, total = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            for part in text_parts(batch):
                for text in part.column(0).to_pylist():
                    length, codes = _codes(text, terms)
                    df[np.unique(codes)] += 1
                    n, total = n + 1, total + length
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], met)), pa.array(np.append([n, total], df[met]))], names=["term", "c"])

    sums = {r["term"]: r["c"] for r in texts.select("low").mapInArrow(run, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()}
    n, total = sums.pop(-2, 0), sums.pop(-1, 0)
    df = np.zeros(len(shared.value), np.int64)
    df[list(sums)] = list(sums.values())
    return n, total, df


def saturated(tf: np.ndarray, length: np.ndarray, average: float) -> np.ndarray:
    return tf / (tf + K1 * (1 - B + B * length / average))


def add_up(best: Best, row: np.ndarray, code: np.ndarray, value: np.ndarray, ids: list, first: np.ndarray, owner: np.ndarray, weight: np.ndarray, asked: np.ndarray | None = None) -> None:
    """Scores the texts ``ids`` for all queries, a bounded number of pairs at a time.

    ``row``, ascending, ``code`` and ``value``: a text's place, a word of it, and what the word counts; from ``first[code]`` on ``owner``
    and ``weight`` name the queries that have the word.  ``asked`` marks the queries that count.
    """
    many = first[code + 1] - first[code]
    pairs = np.bincount(row, many, minlength=len(ids)).astype(np.int64)
    for a, b in runs(pairs, PAIRS, best.step()):
        some = slice(*np.searchsorted(row, (a, b)))
        each = many[some]
        at = np.arange(each.sum()) + np.repeat(first[code[some]] - np.cumsum(each) + each, each)
        cell = np.repeat(row[some] - a, each) * len(best.names) + owner[at]
        score = np.bincount(cell, np.repeat(value[some], each) * weight[at], minlength=(b - a) * len(best.names)).reshape(b - a, -1)
        best.take(score, ids[a:b], score > 0 if asked is None else (score > 0) & asked)


def by_code(code: np.ndarray, n: int, owner: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, owner, weight) in the order of codes."""
    order = np.argsort(code, kind="stable")
    return np.searchsorted(code[order], np.arange(n + 1)), owner[order], weight[order]


def _scored(shared, weights, k: int, types: list):
    """(low, id) -> the k best (qid, id, score) of each query among the task's texts.

    ``weights``: names of the queries, and by term the queries that have it and their weights.
    """

    def run(batches):
        terms = shared.value
        names, first, owner, weight, average = weights.value
        best = Best(names, k)

        def take(made, ids):
            if not len(names):
                return
            row = np.repeat(np.arange(len(made)), [len(c) for _, c in made])
            code, tf = np.unique(row * len(terms) + np.concatenate([c for _, c in made]), return_counts=True)
            row, code = code // max(1, len(terms)), code % max(1, len(terms))
            length = np.array([n for n, _ in made], float)
            add_up(best, row, code, saturated(tf, length[row], average), ids, first, owner, weight)

        for batch in batches:
            for part in text_parts(batch):
                take([_codes(t, terms) for t in part.column(0).to_pylist()], part.column(1).to_pylist())
        yield best.batch(types)

    return run


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, id, score, rank) of the k best documents of each query."""
    asked = query_terms(queries)
    table = asked.limit(MOST_QUERY_TERMS + 1).toArrow()
    if len(table) > MOST_QUERY_TERMS:
        index = Bm25Index.build(corpus, asked)
        return ranked(index.scores(queries), k).withColumn("score", F.round("score", 6))
    spark = corpus.sparkSession
    texts = corpus.select(F.lower("text").alias("low"), "id")
    words = table.column("term").to_pylist()
    terms = {t: i for i, t in enumerate(dict.fromkeys(words))}
    shared = spark.sparkContext.broadcast(terms)
    n, total, df = _statistics(texts, shared)
    code = np.array([terms[w] for w in words], np.int64)
    qids = table.column("qid").to_pylist()
    names = list(dict.fromkeys(qids))
    number = {q: i for i, q in enumerate(names)}
    owner = np.array([number[q] for q in qids], np.int64)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    weight = table.column("qtf").to_numpy() * idf[code] * (K1 + 1) if len(code) else np.zeros(0)
    weights = spark.sparkContext.broadcast((names, *by_code(code, len(terms), owner, weight), total / n if total else 1.0))
    schema = spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, id {dict(corpus.dtypes)['id']}, score double").schema
    found = texts.mapInArrow(_scored(shared, weights, k, [to_arrow_type(f.dataType) for f in schema]), schema)
    return ranked(found, k).withColumn("score", F.round("score", 6))
