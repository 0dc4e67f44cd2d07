"""A vector collection as a table: create, drop, upsert by chunk id, count, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.vectors import vector_topk
from lectern.schemas import VECTOR_LIMITS, VECTOR_ROW


def to_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with a vector -> rows of the collection: page numbers flattened, the number widened."""
    return chunks.select(
        "chunk_id", "method", F.col("rfc").cast("bigint").alias("rfc"), "title", "section_id", "section_path",
        F.col("page_start.printed").cast("bigint").alias("page_start_printed"), F.col("page_end.printed").cast("bigint").alias("page_end_printed"),
        "text", F.col("vector").cast("array<float>").alias("vector"),
    )


class Collection:
    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def ensure(self, recreate: bool = True) -> bool:
        """Makes the table; True if it is new, dropped first if ``recreate``."""
        self._recover()
        if self.spark.catalog.tableExists(self.name):
            if not recreate:
                return False
            self.drop()
        self.spark.createDataFrame([], VECTOR_ROW).write.format("parquet").saveAsTable(self.name)
        return True

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def insert(self, chunks: DataFrame) -> int:
        """Adds rows; one whose id is in the table already replaces it. Strings beyond the limits are an error.

        Where rows are replaced, the new table is written aside and takes the place of the old one when it is whole; what is
        left of a failure in between is put right by the next call.
        """
        self._recover()
        rows = to_rows(chunks)
        for column, most in VECTOR_LIMITS.items():
            rows = rows.withColumn(column, F.when(F.length(column) > most, F.raise_error(F.lit(f"{column} is longer than {most}")).cast("string")).otherwise(F.col(column)))
        rows = rows.persist()
        try:
            n = rows.count()
            old = self.spark.table(self.name)
            if old.join(rows.select("chunk_id"), "chunk_id", "left_semi").isEmpty():
                rows.write.mode("append").insertInto(self.name)
            else:
                kept = old.join(rows.select("chunk_id"), "chunk_id", "left_anti").select(*rows.columns).unionByName(rows)
                kept.write.mode("overwrite").format("parquet").saveAsTable(f"{self.name}_aside")
                self.spark.sql(f"ALTER TABLE {self.name}_aside RENAME TO {self.name}_next")  # from here on it is whole
                self._recover()
            return n
        finally:
            rows.unpersist()

    def _recover(self) -> None:
        """Puts a whole new version in the place of the old one, and drops a part of one."""
        if self.spark.catalog.tableExists(f"{self.name}_next"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.spark.sql(f"ALTER TABLE {self.name}_next RENAME TO {self.name}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_aside")

    def count(self) -> int:
        return self.spark.table(self.name).count()

    def ready(self) -> bool:
        return self.spark.catalog.tableExists(self.name) and not self.spark.table(self.name).isEmpty()

    def search(self, queries: DataFrame, limit: int = 5, where: str | None = None) -> DataFrame:
        """(qid, vector) -> (qid, rank, chunk_id, rfc, title, section_path, page, distance, text)."""
        table = self.spark.table(self.name)
        top = vector_topk(table.withColumnRenamed("chunk_id", "id"), queries, limit, where)
        facts = table.select(F.col("chunk_id").alias("id"), "rfc", "title", "section_path", F.col("page_start_printed").alias("page"), "text")
        return top.join(facts, "id").select("qid", "rank", F.col("id").alias("chunk_id"), "rfc", "title", "section_path", "page", F.col("score").alias("distance"), "text")
