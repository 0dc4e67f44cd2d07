"""A training corpus from ``documents``: language, repeated lines, near copies, test items, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared folder and reads
it back as the next stage's documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import langid
from lectern.llm.decontaminate import drop_leaking
from lectern.llm.linededup import dedup_lines
from lectern.llm.mixing import mix_sources
from lectern.llm.neardup_text import near_duplicates
from lectern.llm.runtime import cut, discard, spill

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents with their types, whatever else ``docs`` has; names are told apart by case where they clash."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that resemble no known language; fills in languages that are not given.

    The languages are those of the documents themselves.  Null and empty texts go; null ids, repeated ids and repeated rows
    are judged one by one; of languages that are equally near, the first by name is taken.
    """
    docs = documents(docs)
    judged = langid.identify(docs, langid.fit_profiles(docs))
    kept = judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= langid.LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated runs of three lines; a document that loses all its words goes.

    Of equal runs the first stays, by id, then by place; null texts stay as they are; ``n_chars`` follows the text.
    """
    cleaned = dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = cleaned.where(~F.coalesce(emptied, F.lit(False)))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies.

    Rows that share an id stay or go together; rows with a null id, without text or without words stay.
    """
    facts = near_duplicates(docs.select("doc_id", "text"))
    surplus = cut(facts.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_copy_id")).distinct())
    return docs.select(*COLUMNS).join(surplus, docs["doc_id"] == F.col("_copy_id"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item; null and empty texts hold none."""
    return drop_leaking(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with the number of copies and of words taken.

    A null source is a source of its own; empty texts have size 0 and are not taken; equal keys are told apart by id.
    """
    mixed = mix_sources(docs.select(*COLUMNS)).where(F.col("copies") > 0)
    return mixed.select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard_join", copies), ("decontamination", decontaminate), ("mixing", mixture)]

#: Rank-order profiles and similarity joins over whole texts have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        done, written = written, spill(stage(spark, docs, sf_dir))
        discard(done)
        docs = written
    return docs
