"""Retrieval evaluation: which rows hold the evidence, recall at k and mean reciprocal rank."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.functions.text import plain_words, squeezed
from lectern.operators.batches import text_parts

KS = (1, 3, 5, 10)
#: Evidence texts that are searched for in one pass, and their characters: each may be a node of the automaton.
EVIDENCE_BLOCK, EVIDENCE_CHARS = 50_000, 2_000_000
#: Matches that are sent on at once, about.
MATCHES = 100_000


def evidence_matches(corpus: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, id) where the text of ``corpus`` (id, text) contains that of ``evidence`` (qid, text), white space squeezed."""
    return contained(corpus.select("id", squeezed(F.col("text")).alias("norm")), evidence.select("qid", squeezed(F.col("text")).alias("norm")))


def contained(corpus: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, id) where ``norm`` of ``corpus`` (id, norm) contains that of ``evidence`` (qid, norm); nulls match nothing.

    One Aho-Corasick pass over the corpus finds all evidence texts of a block at once, however many there are.
    """
    spark = corpus.sparkSession
    norm = corpus.select("id", "norm").where("norm is not null")
    asked = evidence.select("qid", "norm").where("norm is not null")
    schema = f"qid {dict(asked.dtypes)['qid']}, id {dict(norm.dtypes)['id']}"
    found = spark.createDataFrame([], schema)
    batch_types = [to_arrow_type(f.dataType) for f in found.schema.fields]
    n, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("norm")), F.lit(0))).first()
    blocks = max(1, -(-n // EVIDENCE_BLOCK), -(-chars // EVIDENCE_CHARS))
    for b in range(blocks):
        rows = [(r["qid"], r["norm"]) for r in asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()]
        always = [q for q, t in rows if t == ""]

        def run(batches, rows=rows, always=always):
            import ahocorasick

            automaton, names = ahocorasick.Automaton(), {}
            for q, t in rows:
                if t:
                    names.setdefault(t, []).append(q)
            for t, qs in names.items():
                automaton.add_word(t, qs)
            if names:
                automaton.make_automaton()
            def batch_of(qids, ids):
                return pa.RecordBatch.from_arrays([pa.array(qids, batch_types[0]), pa.array(ids, batch_types[1])], names=["qid", "id"])

            for batch in batches:
                qids, ids = [], []
                for part in text_parts(batch, 1):
                    for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        hit = {q for _, qs in automaton.iter(text) for q in qs} if names else set()
                        hit.update(always)
                        qids += hit
                        ids += [i] * len(hit)
                        if len(ids) >= MATCHES:
                            yield batch_of(qids, ids)
                            qids, ids = [], []
                yield batch_of(qids, ids)

        found = found.unionByName(norm.mapInArrow(run, found.schema))
    return found


def grid(questions: DataFrame, sources: list[str]) -> DataFrame:
    """(source, qid) for every question and source."""
    return questions.select("qid").distinct().select(F.explode(F.array(*[F.lit(x) for x in sources])).alias("source"), "qid")


def names_of(rankings: DataFrame) -> list[str]:
    return sorted(r["source"] for r in rankings.select("source").distinct().collect())


def first_hits(rankings: DataFrame, correct: DataFrame, questions: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(source, qid, first) for every question and source of ``rankings`` (source, qid, id, rank): the first correct rank.

    ``sources`` names the rankings; without it they are looked up, which evaluates the rankings once more.
    """
    hits = rankings.join(correct.select("qid", "id").distinct(), ["qid", "id"]).groupBy("source", "qid").agg(F.min("rank").alias("first"))
    return grid(questions, sources or names_of(rankings)).join(hits, ["source", "qid"], "left")


def recall_mrr(rankings: DataFrame, correct: DataFrame, questions: DataFrame, ks: tuple[int, ...] = KS, sources: list[str] | None = None) -> DataFrame:
    """One row a source: recall at each k and MRR; questions without a correct row count as misses."""
    per = first_hits(rankings, correct, questions, sources)
    hit = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 4).alias(f"recall_{k}") for k in ks]
    return per.groupBy("source").agg(F.count("*").alias("n"), *hit, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def per_question(rankings: DataFrame, correct: DataFrame, questions: DataFrame, k: int = 10, sources: list[str] | None = None) -> DataFrame:
    """(source, qid, ranked, correct, correct_hits): lists of ids, correct ones sorted."""
    listed = rankings.where(F.col("rank") <= k).groupBy("source", "qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ranked"))
    right = correct.groupBy("qid").agg(F.array_sort(F.collect_set("id")).alias("correct"))
    kind = dict(rankings.dtypes)["id"]
    empty = F.array().cast(f"array<{kind}>")
    joined = grid(questions, sources or names_of(rankings)).join(listed, ["source", "qid"], "left").join(right, "qid", "left")
    joined = joined.withColumns({"ranked": F.coalesce("ranked", empty), "correct": F.coalesce("correct", empty)})
    return joined.select("source", "qid", "ranked", "correct", F.array_intersect("ranked", "correct").alias("correct_hits"))


def label_sources(rankings: dict[str, DataFrame]) -> DataFrame:
    """One table (source, qid, id, rank) of several rankings."""
    return reduce(DataFrame.unionByName, [r.select(F.lit(name).alias("source"), "qid", "id", "rank") for name, r in rankings.items()])


def prefix_matches(corpus: DataFrame, evidence: DataFrame, longest: int = 120) -> DataFrame:
    """(qid, id) where ``corpus`` (id, text) holds the first characters of ``evidence`` (qid, text), both as plain words.

    Join the result on a key of both sides to ask within equal pages only.
    """
    start = F.substring(plain_words(F.col("text")), 1, longest)
    return contained(corpus.select("id", plain_words(F.col("text")).alias("norm")), evidence.select("qid", start.alias("norm")))
