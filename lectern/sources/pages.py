"""Paged documents: text files with page marks, or PDFs where a reader for them is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import rfc_from_path

PAGE_MARK = "%%PAGE%%\n"


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path) of matching files, sorted; an error if there are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path").orderBy("path")
    if files.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return files


def read_marked_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, pdf, text): one row a page of text files whose pages are separated by a mark."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", PAGE_MARK, -1)).alias("pdf", "text"))


def read_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(rfc, path, pdf, text) of the text layers of PDF files named ``RFC <n>.pdf``; needs pymupdf on the executors."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")

    def pages(batches):
        import pandas as pd
        import pymupdf

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with pymupdf.open(stream=content, filetype="pdf") as doc:
                    yield pd.DataFrame({"path": path, "pdf": range(doc.page_count), "text": [doc[i].get_text() for i in range(doc.page_count)]})

    return raw.mapInPandas(pages, "path string, pdf int, text string").withColumn("rfc", rfc_from_path(F.col("path")))
