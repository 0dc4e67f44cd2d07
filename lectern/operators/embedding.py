"""Embedding with a cache: only missing texts are encoded."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import cache_key, passage
from lectern.operators.reporting import latest
from lectern.schemas import EMBEDDING_CACHE

DIMENSION, BATCH = 1024, 64
Encoder = Callable[[list[str]], np.ndarray]


def hash_encoder(dimension: int = DIMENSION) -> Encoder:
    """A stand-in for a model: unit vectors seeded by the text's digest."""

    def encode(texts: list[str]) -> np.ndarray:
        made = np.array([np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).normal(size=dimension) for t in texts]).reshape(len(texts), dimension)
        return (made / np.linalg.norm(made, axis=1, keepdims=True)).astype(np.float32)

    return encode


def with_keys(rows: DataFrame, model: str) -> DataFrame:
    """Adds key, the digest of model and passage text."""
    return rows.withColumn("key", cache_key(model, passage(F.col("text"))))


def cache_hits(keyed: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    return keyed.join(cache.where(F.col("model") == model).select("key"), "key", "left_semi")


def cache_misses(keyed: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    return keyed.join(cache.where(F.col("model") == model).select("key"), "key", "left_anti")


def encode(rows: DataFrame, encoder_factory: Callable[[], Encoder], prefix: str = "passage: ") -> DataFrame:
    """(key, text) -> (key, vec) of the text behind ``prefix``; the encoder is made once a task, on its first batch."""

    def run(batches):
        encoder = None
        for pdf in batches:
            encoder = encoder or encoder_factory()
            for k in range(0, len(pdf), BATCH):
                part = pdf.iloc[k : k + BATCH]
                yield pd.DataFrame({"key": part["key"], "vec": list(encoder([f"{prefix}{t}" for t in part["text"]]))})

    return rows.select("key", "text").mapInPandas(run, "key string, vec array<float>")


def embed(rows: DataFrame, cache: DataFrame, model: str, encoder_factory: Callable[[], Encoder] = hash_encoder) -> tuple[DataFrame, DataFrame]:
    """``rows`` with vec, and the rows (model, key, vec) to add to the cache."""
    keyed = with_keys(rows, model)
    fresh = encode(cache_misses(keyed, cache, model).dropDuplicates(["key"]), encoder_factory).select(F.lit(model).alias("model"), "key", "vec")
    known = cache.where(F.col("model") == model).select("model", "key", "vec").unionByName(fresh).select("key", "vec")
    return keyed.join(known, "key").drop("key"), fresh


class EmbeddingStore:
    """Vectors by model and key in a folder: every upsert adds files, the newest row of a key counts.

    Nothing is overwritten in place, so a failed or repeated upsert harms nothing; ``compact`` writes the rows that count
    to a new folder and points to it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self) -> tuple[int, str]:
        names = [f.getPath().getName() for f in self._fs().listStatus(self._at(self.path))] if self._fs().exists(self._at(self.path)) else []
        whole = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and (n == "v0" or self._fs().exists(self._at(f"{self.path}/{n}/_SUCCESS")))]
        newest = max(whole, default=0)
        return newest, f"{self.path}/v{newest}"

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def rows(self, model: str | None = None) -> DataFrame:
        """(model, key, vec); of several rows of a key the last one written."""
        _, folder = self._folder()
        if not self._fs().exists(self._at(folder)):
            return self.spark.createDataFrame([], EMBEDDING_CACHE)
        found = self.spark.read.schema("model string, key string, vec array<float>, at long").parquet(folder)
        found = found if model is None else found.where(F.col("model") == model)
        return latest(found, "at", "model", "key").drop("at")

    def upsert(self, fresh: DataFrame) -> None:
        """Adds rows (model, key, vec)."""
        _, folder = self._folder()
        fresh.select("model", "key", "vec").withColumn("at", F.lit(time.time_ns())).write.mode("append").partitionBy("model").parquet(folder)

    def compact(self) -> None:
        newest, folder = self._folder()
        self.rows().withColumn("at", F.lit(0).cast("long")).write.mode("overwrite").partitionBy("model").parquet(f"{self.path}/v{newest + 1}")
        self._fs().delete(self._at(folder), True)

    def embed(self, rows: DataFrame, model: str, encoder_factory: Callable[[], Encoder] = hash_encoder) -> DataFrame:
        """``rows`` with vec; texts that are not in the store are encoded and added to it first."""
        _, fresh = embed(rows, self.rows(model), model, encoder_factory)
        self.upsert(fresh)
        return with_keys(rows, model).join(self.rows(model).select("key", "vec"), "key").drop("key")
