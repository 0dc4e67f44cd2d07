"""Token counts as delta-maintained rollups: signed changes, additive totals, idempotent batch commits.

A change says that a document was inserted, deleted or counted anew under one tokenizer version.  A batch of changes is
reduced to one signed row for each source, language and tokenizer and committed under its id by a single rename in the
shared file system: a batch that is committed already is left alone, so a batch can be sent again after any failure.
Totals are the sum of the last snapshot and of the batches it does not hold; ``compact`` folds batches into a new
snapshot.  A snapshot names only the batches that it took up itself; those of the snapshot before are moved to a folder
of folded batches, which tells that they were committed.  Nothing is ever recounted.

Tokenizers are public vocabulary files, read on the driver from a path that is a parameter and sent to the tasks.

Edge cases: null and empty texts have 0 tokens; null sources and languages are groups of their own; null ids and ids
that several rows share count like any other; a group whose totals return to zero is not listed; equal rows are separate
changes; empty batches commit and change nothing; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.runtime import extend

#: The pattern that cuts texts into pieces before byte-pair merging. A fixed value of these vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
GROUP = ["source", "lang", "tokenizer"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]


def read_vocabulary(path: str) -> bytes:
    """A vocabulary of byte-pair ranks: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return f.read()


#: Stands for a vocabulary that has no file: runs of characters outside white space.
WORDS = b""
BLANK = " \t\n\v\f\r"


def _encoders(vocabularies: dict[str, bytes]):
    """For each tokenizer a function from a text to its number of tokens."""
    import tiktoken

    made = []
    for name, raw in vocabularies.items():
        if raw == WORDS:
            made.append(lambda x: len(_WORD.findall(x)))
            continue
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        encoding = tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        made.append(lambda x, encoding=encoding: len(encoding.encode_ordinary(x)))
    return made


def count_tokens(docs: DataFrame, vocabularies: dict[str, bytes], keep: list[str] | None = None) -> DataFrame:
    """``docs`` (with text) and, for each tokenizer, a long column ``tokens_<name>``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def kernel():
        encoders = _encoders(shared.value)

        def run(column):
            texts = [x or "" for x in column.to_pylist()]
            return [pa.array(np.fromiter((e(x) for x in texts), np.int64, len(texts))) for e in encoders]

        return run

    return extend(docs, kernel, ", ".join(f"tokens_{name} long" for name in vocabularies), keep)


def count_both(docs: DataFrame, vocabularies: dict[str, bytes], keep: list[str] | None = None) -> DataFrame:
    """``docs`` (with text) with n_chars and tokens_<name>, and the same of the trimmed text: clean_chars and clean_<name>."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def kernel():
        encoders = _encoders(shared.value)

        def run(column):
            texts = [x or "" for x in column.to_pylist()]
            trimmed = [x.strip(BLANK) for x in texts]
            out = []
            for measure in (len, *encoders):
                raw = [measure(x) for x in texts]
                out += [pa.array(raw, pa.int64()), pa.array([n if len(x) == len(y) else measure(y) for n, x, y in zip(raw, texts, trimmed, strict=True)], pa.int64())]
            return out

        return run

    return extend(docs, kernel, "n_chars long, clean_chars long, " + ", ".join(f"tokens_{name} long, clean_{name} long" for name in vocabularies), keep)


def signed(changes: DataFrame) -> DataFrame:
    """Changes (op, source, lang, tokenizer, n_docs, n_tokens, n_chars, old_tokens, old_chars) -> one signed row a group.

    ``op`` is insert, delete or revise; the old_ columns are read for revise only.  ``n_docs`` is how many equal
    documents a row stands for; the other numbers are their sums.
    """
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1)
    old = {c: F.col(f"old_{c[2:]}") if f"old_{c[2:]}" in changes.columns else F.lit(0) for c in MEASURES[1:]}
    value = {"n_docs": F.when(F.col("op") == "revise", 0).otherwise(sign * F.col("n_docs"))}
    for c in MEASURES[1:]:
        value[c] = F.when(F.col("op") == "revise", F.col(c) - F.coalesce(old[c], F.lit(0))).otherwise(sign * F.col(c))
    known = changes.where(F.col("op").isin("insert", "delete", "revise"))
    return known.groupBy(*GROUP).agg(*[F.sum(F.coalesce(v, F.lit(0))).cast("long").alias(c) for c, v in value.items()])


class Ledger:
    """Batches and snapshots in one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._files = self._jvm.org.apache.hadoop.fs
        self._fs = self._files.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._files.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    @staticmethod
    def _safe(batch: str) -> str:
        plain = re.sub(r"[^A-Za-z0-9_.-]", "_", batch)
        return plain if plain == batch and not plain.startswith((".", "_")) else f"b-{plain}-{hashlib.sha256(batch.encode()).hexdigest()[:12]}"

    def _publish(self, df: DataFrame, folder: str, name: str) -> bool:
        """Writes aside and renames; False if the name is taken, by then or meanwhile."""
        if self._fs.exists(self._path(f"{folder}/{name}")):
            return False
        aside = f"{self.root}/aside/{folder}-{name}-{self._jvm.java.util.UUID.randomUUID()}"
        df.write.parquet(aside)
        self._fs.mkdirs(self._path(folder))
        context = self._files.FileContext.getFileContext(self._path(folder).toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._files.Path(aside), self._path(f"{folder}/{name}"), none)
        except Exception as e:
            self._fs.delete(self._files.Path(aside), True)
            if "AlreadyExists" in str(e) or self._fs.exists(self._path(f"{folder}/{name}")):
                return False
            raise
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the batch; False, and no work, if it was committed before."""
        name = self._safe(batch)
        if any(self._fs.exists(self._path(f"{folder}/{name}")) for folder in ("batches", "folded")):
            return False
        return self._publish(signed(changes), "batches", name)

    def _held(self) -> set[str]:
        """Names of the batches that the last snapshot took up; those of earlier ones are folded away."""
        last = self._names("snapshots")[-1:]
        if not last:
            return set()
        rows = self.spark.read.parquet(f"{self.root}/snapshots/{last[0]}").where("batch is not null").select("batch").collect()
        return {r["batch"] for r in rows}

    def _sum(self) -> tuple[DataFrame, list[str]]:
        """Totals, and the names of the batches that no snapshot holds."""
        last, held = self._names("snapshots")[-1:], self._held()
        fresh = [b for b in self._names("batches") if b not in held]
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
        rows = self.spark.createDataFrame([], schema)
        if last:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.root}/snapshots/{last[0]}").where("batch is null").select(*GROUP, *MEASURES))
        if fresh:
            rows = rows.unionByName(self.spark.read.schema(schema).parquet(*[f"{self.root}/batches/{b}" for b in fresh]))
        return rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in MEASURES]), fresh

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_chars) of all committed batches."""
        rows, _ = self._sum()
        return rows.where(" or ".join(f"{c} <> 0" for c in MEASURES))

    def compact(self) -> int:
        """Folds all committed batches into a new snapshot; gives its number."""
        self._fs.mkdirs(self._path("folded"))
        for name in self._held():
            if self._fs.exists(self._path(f"batches/{name}")):
                self._fs.rename(self._path(f"batches/{name}"), self._path(f"folded/{name}"))
        rows, fresh = self._sum()
        number = len(self._names("snapshots"))
        batches = self.spark.createDataFrame([(b,) for b in fresh], "batch string")
        both = rows.withColumn("batch", F.lit(None).cast("string")).unionByName(batches, allowMissingColumns=True)
        self._publish(both, "snapshots", f"{number:08d}")
        return number


def corpus_batches(docs: DataFrame, vocabularies: dict[str, bytes]) -> dict[str, DataFrame]:
    """Three batches from (doc_id, text, source, lang): load all, count trimmed texts anew, retract exact copies.

    Texts are read once: a row carries its counts before and after trimming, so nothing is joined on ids, which may be null
    or shared.  Of equal trimmed texts one row stays, that of the least id, source and language (null ids last, null
    sources and languages first); a null text equals an empty one.  Copies are counted in groups of equal text, source and
    language before anything is joined, so a text that a third of all rows share is a handful of rows.
    """
    from lectern.llm.runtime import spill

    names = list(vocabularies)
    text = F.col("text").cast("string")
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    base = base.withColumns({"h1": F.xxhash64(trimmed), "h2": F.xxhash64(F.lit("second"), trimmed)})
    rows = spill(count_both(base, vocabularies, ["doc_id", "source", "lang", "h1", "h2"]))

    def long(part: DataFrame, op: str, n_docs, now: str, before: str | None = None) -> DataFrame:
        """A row for each tokenizer; ``now`` and ``before`` name the counts to take."""
        per = F.explode(F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.col(f"{now}_{n}").alias("n_tokens"), *([F.col(f"{before}_{n}").alias("old_tokens")] if before else [])) for n in names])).alias("t")
        chars = {"tokens": "n_chars", "clean": "clean_chars"}
        more = [F.col(chars[before]).alias("old_chars")] if before else []
        return part.select(F.lit(op).alias("op"), "source", "lang", n_docs.cast("long").alias("n_docs"), F.col(chars[now]).alias("_chars"), *more, per).select("*", "t.*").drop("t").withColumnRenamed("_chars", "n_chars")

    sums = ["clean_chars", *[f"clean_{x}" for x in names]]
    groups = rows.groupBy("h1", "h2", "source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), *[F.sum(c).alias(c) for c in sums])
    place = F.struct(F.col("low").isNull().alias("none"), "low", "source", "lang")
    first = groups.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.sum("n").alias("copies")).where("copies > 1")
    surplus = F.col("n") - F.when(place.eqNullSafe(F.col("first")), 1).otherwise(0)
    copies = groups.join(first, ["h1", "h2"]).withColumn("surplus", surplus).where("surplus > 0")
    # rows of a group have equal texts, so each has an equal share of its sums
    copies = copies.select("source", "lang", "surplus", *[(F.col(c) / F.col("n") * F.col("surplus")).alias(c) for c in sums]).select("source", "lang", "surplus", *[F.round(c).cast("long").alias(c) for c in sums])
    return {
        "load": long(rows, "insert", F.lit(1), "tokens"),
        "revise-trimmed": long(rows.where("clean_chars <> n_chars"), "revise", F.lit(1), "clean", "tokens"),
        "retract-copies": long(copies, "delete", F.col("surplus"), "clean"),
    }
