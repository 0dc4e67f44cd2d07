"""Incremental ingest: new documents become passages that are ready to be embedded and searched.

    python -m jobs.ingest_passages --config jobs/ingest_passages.json --input /data/documents --output /data/passages --checkpoint /data/passages.checkpoint

The input is a folder (or file, or glob) of Parquet files with doc_id, text, lang and source, to which files are added.  Every
run takes the files that no run has taken before, cuts their texts into overlapping windows that end at white space, and adds
one row a window, with its place in the document and the key of the embedding cache, to the output: Parquet, partitioned by
source.  A stream with ``availableNow`` does that: its checkpoint remembers the files, and its sink's log shows whole batches
only, so a run that fails, or is repeated, neither loses nor doubles a row.  A file is meant to be written once, under a name
of its own, as Spark's file streams have it.

A document that comes again in a later file is ingested again; ``version`` (the time of its file) tells the revisions apart,
and :func:`current` gives the passages of each document's newest.  Texts that are null or blank give no passages; a null source and an empty
one are one partition, read back as null; rows with a null id are ingested and are all current; equal rows within a file stay as they are.
"""

from __future__ import annotations

import logging
import re
import sys
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, load_config
from lectern.functions.text import cache_key, passage
from lectern.operators.chunking import OVERLAP, WINDOW, chunk

log = logging.getLogger("ingest_passages")

SCHEMA = "doc_id long, text string, lang string, source string"
PASSAGE = "doc_id long, lang string, start int, end int, n_chars int, key string, text string, version timestamp, source string"


@dataclass(frozen=True)
class Config:
    input: str
    output: str
    checkpoint: str
    window: int = WINDOW
    overlap: int = OVERLAP
    model: str = "e5"
    files_per_batch: int = 1000

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.window:
            raise ValueError("overlap must be at least 0 and below window")


def passages(documents: DataFrame, config: Config) -> DataFrame:
    """Documents (with version) -> their passages; row by row, so without a shuffle, in batch and stream alike."""
    page = F.array(F.struct("text", F.lit(0).alias("pdf"), F.lit(1).alias("printed")))
    # the chunker hands on a document's number and title; here these are the row's other columns
    row = F.struct(*[F.col(c) for c in ("doc_id", "lang", "source", "version")]).alias("title")
    docs = documents.where("text is not null").select(F.lit(0).alias("rfc"), row, page.alias("pages"))
    made = chunk(docs, "naive", config.window, config.overlap)
    return made.select("title.doc_id", "title.lang", "start", "end", "n_chars", cache_key(config.model, passage(F.col("text"))).alias("key"), "text", "title.version", F.col("title.source").alias("source"))


def run(spark: SparkSession, config: Config) -> int:
    """Ingests what is new; gives the number of passages written (by the last hundred batches, of which a stream keeps account)."""
    # the last character as a class makes a glob of the path, so that a single file is not taken for a folder of partitions
    path = config.input.rstrip("/")
    path = path if re.search(r"[*?\[{]", path) else f"{path[:-1]}[{path[-1]}]"
    new = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", config.files_per_batch).parquet(path)
    new = new.select("*", F.col("_metadata.file_modification_time").alias("version"))
    taken = new.observe("read", F.count(F.lit(1)).alias("rows"))
    made = passages(taken, config).observe("written", F.count(F.lit(1)).alias("rows"))
    query = made.writeStream.format("parquet").partitionBy("source").option("path", config.output).option("checkpointLocation", config.checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    read = written = 0
    for p in query.recentProgress:
        seen = p.observedMetrics
        if "read" in seen and "written" in seen:
            log.info("batch %d: read %d documents, wrote %d passages", p.batchId, seen["read"].rows, seen["written"].rows)
            read, written = read + seen["read"].rows, written + seen["written"].rows
    log.info("read %d new documents from %s, wrote %d passages to %s", read, config.input, written, config.output)
    return written


def read_output(spark: SparkSession, output: str) -> DataFrame:
    """All passages that whole batches have written; none where no run has found a file yet."""
    try:
        return spark.read.schema(PASSAGE).parquet(output)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PASSAGE)


def current(found: DataFrame) -> DataFrame:
    """The passages of each document's newest version."""
    newest = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("version").alias("_newest"))
    joined = found.join(newest, F.col("doc_id") == F.col("_id"), "left")
    return joined.where(F.col("_newest").isNull() | (F.col("version") == F.col("_newest"))).drop("_id", "_newest")


if __name__ == "__main__":
    command_line("ingest_passages", run, load_config(Config, sys.argv[1:], __doc__.split("\n")[0]))
