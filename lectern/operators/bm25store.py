"""A stored inverted index for BM25: built once, added to by segments, merged, searched without reading a text.

Tables in a folder, all plain Parquet:

* ``postings/segment=<name>/bucket=<b>``: a row for each term and slice of documents, with the postings (id, tf, length) and what
  bounds their scores: the highest tf and the least length.  Terms are dealt to buckets by their hash, and sorted within.
* ``stats/segment=<name>``: documents, tokens, and the segments that this one replaces; written last, so that a segment is either
  there as a whole or not at all.  Writing a segment again replaces it.

Documents are dealt to slices of about ``DOCS`` by a hash of their id, so a word that every document has is many rows of bounded
size, and all words' rows of a slice are about the same documents.

A search reads the buckets and the row groups of its terms only.  A document's score is at most the sum of its slice's bounds, so
the slices with the best bounds are scored first; their k-th best score is a threshold, and of the other slices only those are
scored whose bounds reach it.  The result is that of ``bm25.bm25_topk`` over all documents: scores ranked after rounding to
six decimals, then by id.

Documents' ids are distinct over all segments; a null text has no words; an id may be null; empty tables make empty segments.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lectern.functions.text import tokens
from lectern.operators import bm25
from lectern.operators.bm25 import K1, B, query_terms, ranked, small
from lectern.operators.topk import Best
from lectern.shared import cut

#: Documents of a slice, about; buckets of terms; slices of a query that are scored first.
DOCS, BUCKETS, FIRST = 1024, 64, 4
#: Terms named in a filter of the scan; with more of them whole buckets are read and joined.
MOST_NAMED = 500
#: Weights of terms and names of slices up to this number are broadcast.
MOST_SENT = 200_000
_STATS = "segment string, n long, tokens long, replaces array<string>"


class StoredIndex:
    def __init__(self, spark: SparkSession, folder: str, docs: int = DOCS, buckets: int = BUCKETS):
        self.spark, self.folder, self.docs, self.buckets = spark, folder.rstrip("/"), docs, buckets

    # --- segments -------------------------------------------------------------------------------------------------

    def segments(self) -> DataFrame:
        """(segment, n, tokens) of those that no other replaces."""
        found = self._stats()
        gone = found.select(F.explode("replaces").alias("segment"))
        return found.join(gone, "segment", "left_anti").select("segment", "n", "tokens")

    def add(self, corpus: DataFrame, segment: str, replaces: tuple[str, ...] = ()) -> None:
        """Adds documents (id, text) as a segment; what is there is not read."""
        ts = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))
        sums = corpus.select(F.size(ts).alias("length")).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
        slice_ = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(sums["n"] / self.docs)))).cast("int")
        # dealt by slice once, as texts, which are half the bytes of their words; both groupings below are within a slice
        dealt = corpus.select("id", "text", slice_.alias("slice")).repartition("slice").select("slice", "id", ts.alias("ts")).withColumn("length", F.size("ts"))
        counted = dealt.select("slice", "id", "length", F.explode("ts").alias("term")).groupBy("slice", "id", "length", "term").agg(F.count("*").cast("int").alias("tf"))
        self._write(counted, segment, sums["n"], sums["tokens"], replaces)

    def merge(self, segment: str) -> None:
        """All segments as one, dealt to slices anew; searches see the old ones until it is whole."""
        old = [r.segment for r in self.segments().collect()]
        if segment in old:
            raise ValueError(f"{segment} is one of the segments to merge")
        sums = self._sums()
        slice_ = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(sums["n"] / self.docs)))).cast("int")
        flat = self._postings().select(F.inline("postings"), "term").select(slice_.alias("slice"), "id", "length", "term", "tf")
        self._write(flat, segment, sums["n"], sums["tokens"], tuple(old))

    def _write(self, counted: DataFrame, segment: str, n: int, n_tokens: int, replaces: tuple[str, ...]) -> None:
        made = counted.groupBy("slice", "term").agg(F.count("*").cast("int").alias("df"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.sort_array(F.collect_list(F.struct("id", "tf", "length"))).alias("postings"))
        made = made.withColumn("bucket", self._bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "slice")
        made.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/segment={segment}")
        row = self.spark.createDataFrame([(n, n_tokens, list(replaces))], "n long, tokens long, replaces array<string>")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/stats/segment={segment}")

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _stats(self) -> DataFrame:
        try:
            return self.spark.read.schema(_STATS).parquet(f"{self.folder}/stats")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _STATS)

    def _sums(self):
        return self.segments().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()

    def _postings(self) -> DataFrame | None:
        """Rows of all segments, with segment and bucket; None if no segment has a word."""
        names = [r.segment for r in self.segments().where("tokens > 0").collect()]
        if not names:
            return None
        return self.spark.read.option("basePath", f"{self.folder}/postings").parquet(*[f"{self.folder}/postings/segment={s}" for s in names])

    # --- search ---------------------------------------------------------------------------------------------------

    def met(self, asked: DataFrame) -> DataFrame | None:
        """Postings of the terms of ``asked`` (term): of their buckets, and by name if they are few."""
        rows = self._postings()
        if rows is None:
            return None
        terms = asked.select("term").distinct()
        named = [r.term for r in terms.limit(MOST_NAMED + 1).collect()]
        if len(named) <= MOST_NAMED:
            buckets = [r.b for r in self.spark.createDataFrame([(t,) for t in named], "term string").select(self._bucket(F.col("term")).alias("b")).distinct().collect()]
            return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(named))
        buckets = [r.b for r in terms.select(self._bucket(F.col("term")).alias("b")).distinct().collect()]
        return rows.where(F.col("bucket").isin(buckets)).join(small(terms, MOST_SENT), "term", "left_semi")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(qid, text) -> (qid, id, score, rank): the k best documents of each query."""
        asked = query_terms(queries)
        met = self.met(asked)
        if met is None:
            return ranked(self.spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, id long, score double"), k)
        search = _Search(met, asked, self._sums(), k)
        return ranked(search.first.unionByName(search.scores(search.rest)), k)

    def skipped(self, queries: DataFrame, k: int = 10) -> tuple[int, int]:
        """Of how many pairs of query and slice no posting is scored, and of how many there are."""
        asked = query_terms(queries)
        met = self.met(asked)
        if met is None:
            return 0, 0
        search = _Search(met, asked, self._sums(), k)
        n = search.bounds.count()
        return n - search.chosen.count() - search.rest.count(), n


class _Search:
    """What a search finds out on its way, each step written for the next ones.

    ``bounds`` (qid, segment, slice, bound): the most that a document of the slice can score; ``chosen``: the slices of each
    query that promise most; ``first``: the best scores within these; ``rest``: the other slices that may hold one of its k best.

    The postings of a slice go to one task once, however many queries ask for them, and k rows a query and slice come back.
    Queries with more terms than ``MOST_QUERY_TERMS`` together take the way by joins.
    """

    def __init__(self, met: DataFrame, asked: DataFrame, sums, k: int):
        self.met, self.average, self.k = met, sums["tokens"] / max(1, sums["n"]), k
        df = met.groupBy(F.col("term").alias("_term")).agg(F.sum("df").alias("df"))
        n, df_ = F.lit(sums["n"]), F.col("df")
        idf = F.log(1 + (n - df_ + 0.5) / (df_ + 0.5))
        self.weights = cut(asked.join(df, F.col("term") == F.col("_term")).select("qid", "term", "qtf", idf.alias("idf")))
        self.table = self.weights.limit(bm25.MOST_QUERY_TERMS + 1).toArrow()
        self.few = len(self.table) <= bm25.MOST_QUERY_TERMS
        self.shared = self._broadcast() if self.few else None
        most = self.part(F.col("max_tf"), F.col("min_length"))
        bounds = met.select("segment", "slice", "term", "max_tf", "min_length").join(small(self.weights, MOST_SENT), "term")
        self.bounds = cut(bounds.groupBy("qid", "segment", "slice").agg(F.sum(most).alias("bound")))
        by_bound = Window.partitionBy("qid").orderBy(F.desc("bound"), "segment", "slice")
        placed = self.bounds.withColumn("_place", F.row_number().over(by_bound))
        self.chosen = cut(placed.where(F.col("_place") <= FIRST).select("qid", "segment", "slice"))
        self.first = cut(self.scores(self.chosen))
        by_score = Window.partitionBy("qid").orderBy(F.desc("score"))
        kth = self.first.withColumn("_place", F.row_number().over(by_score)).where(F.col("_place") == k)
        least = kth.select(F.col("qid").alias("_qid"), (F.col("score") - 1e-5).alias("_least"))  # less what rounding may hide
        others = self.bounds.join(self.chosen, ["qid", "segment", "slice"], "left_anti").join(least, F.col("qid") == F.col("_qid"), "left")
        self.rest = cut(others.where(F.col("_least").isNull() | (F.col("bound") >= F.col("_least"))).select("qid", "segment", "slice"))

    def scores(self, slices: DataFrame) -> DataFrame:
        """(qid, id, score) within the slices (qid, segment, slice) of documents that share a word with their query: the k best of each slice."""
        if not self.few:
            return self.all_scores(slices)
        here = small(slices.select("segment", "slice").distinct(), MOST_SENT)
        rows = self.met.select("segment", "slice", "term", *[F.col(f"postings.{c}").alias(c) for c in ("id", "tf", "length")]).join(here, ["segment", "slice"], "left_semi")
        kinds = dict(self.met.select(F.col("postings.id")).dtypes)["id"].removeprefix("array<")[:-1], dict(self.weights.dtypes)["qid"]
        schema = StructType.fromDDL(f"qid {kinds[1]}, id {kinds[0]}, score double")
        run = _scored(self.shared, self.k, self.average or 1.0, [to_arrow_type(f.dataType) for f in schema.fields])
        key = ("segment", "slice")
        return rows.groupBy(*key).cogroup(slices.select("qid", *key).groupBy(*key)).applyInArrow(run, schema)

    def all_scores(self, slices: DataFrame) -> DataFrame:
        """The same by joins, all documents of the slices."""
        rows = self.met.select("segment", "slice", "term", "postings").join(self.weights, "term").join(slices, ["qid", "segment", "slice"])
        flat = rows.select("qid", "qtf", "idf", F.inline("postings"))
        return flat.groupBy("qid", "id").agg(F.sum(self.part(F.col("tf"), F.col("length"))).alias("score")).where("score > 0")

    def _broadcast(self):
        """Numbers of the terms, names of the queries, and by term the queries that have it and their weights."""
        words, qids = self.table.column("term").to_pylist(), self.table.column("qid").to_pylist()
        terms = {t: i for i, t in enumerate(dict.fromkeys(words))}
        number = {q: i for i, q in enumerate(dict.fromkeys(qids))}
        weight = self.table.column("qtf").to_numpy() * self.table.column("idf").to_numpy() * (K1 + 1)
        lists = bm25.by_code(np.array([terms[w] for w in words], np.int64), len(terms), np.array([number[q] for q in qids], np.int64), weight)
        return self.met.sparkSession.sparkContext.broadcast((terms, number, *lists))

    def part(self, tf: Column, length: Column) -> Column:
        return F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(self.average)))


def _scored(shared, k: int, average: float, types: list):
    """Postings of a slice and the queries that ask for it -> the k best (qid, id, score) of each of these queries."""

    def run(postings: pa.Table, slices: pa.Table) -> pa.Table:
        terms, number, first, owner, weight = shared.value
        best = Best(list(number), k)
        if len(postings) and len(slices):
            asked = np.zeros(len(number), bool)
            asked[[number[q] for q in slices.column("qid").to_pylist()]] = True
            met = [terms[t] for t in postings.column("term").to_pylist()]
            lists = postings.column("id").combine_chunks()
            names = lists.flatten().dictionary_encode(null_encoding="encode")
            row = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            code = np.repeat(np.array(met, np.int64), lists.value_lengths().to_numpy(zero_copy_only=False))
            tf, length = (postings.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("tf", "length"))
            order = np.argsort(row, kind="stable")
            value = bm25.saturated(tf[order], length[order], average)
            bm25.add_up(best, row[order], code[order], value, names.dictionary.to_pylist(), first, owner, weight, asked)
        return pa.Table.from_batches([best.batch(types)])

    return run
