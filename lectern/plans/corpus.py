"""From pages to chunks: clean, title, chunk; and the embedding of chunks into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.chunking import chunk
from lectern.operators.embedding import embed, hash_encoder
from lectern.operators.pagetext import clean_pages, document_titles, gather_pages
from lectern.sources.collection import Collection


def build_chunks(pages: DataFrame, method: str) -> DataFrame:
    """(rfc, pdf, printed, text) -> chunks by ``method``; documents without a body give none."""
    docs = clean_pages(gather_pages(pages, "rfc")).join(document_titles(pages, "rfc"), "rfc", "left")
    return chunk(docs, method)


def ingest(chunks: DataFrame, cache: DataFrame, collection: Collection, model: str, encoder_factory=hash_encoder, recreate: bool = True) -> tuple[int, DataFrame]:
    """Embeds chunks, reusing the cache, and inserts them; gives their number and the new cache rows."""
    collection.ensure(recreate)
    vectors, fresh = embed(chunks, cache, model, encoder_factory)
    return collection.insert(vectors.withColumn("vector", F.col("vec")).drop("vec")), fresh
