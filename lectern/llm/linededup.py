"""Line deduplication over overlapping windows of three consecutive lines, DataFrame functions throughout.

Lines are trimmed of blanks, and blank lines are passed over when windows are formed.  Each window is known by two
64-bit hashes.  A window that occurs more than once anywhere keeps its first occurrence, by document id and place; all
later ones cover their three lines.  Covered places are merged and their lines are cut from the text, whatever other
windows they lie in; other lines, blank ones included, stay as they are.  Of equal lines the first is never covered, so
each line that occurs stays somewhere.

The first occurrence is a minimum, combined before the shuffle, so a window shared by a third of all documents costs
one row a task there; the join back is a plain equi-join whose hot partitions Spark splits.

Edge cases: null texts stay null; texts with fewer than three filled lines stay as they are; rows that share id and
text are one document and get the same answer, rows that share only the id are ordered by a hash of the text; null ids
come first; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import spill, without

WINDOW = 3
_BLANKS = " \t\r\x0b\x0c"


def _filled(text: Column) -> Column:
    """Array of (at, line): place and trimmed content of the lines that are not blank."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(_BLANKS)).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def _who(text: Column) -> Column:
    return F.struct(F.col("doc_id").alias("id"), F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).alias("text"))


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(h1, h2, who, k): every window of ``width`` filled lines; k counts filled lines from 0."""
    text = F.col("text")
    hashed = docs.where(text.isNotNull()).select(
        _who(text).alias("who"),
        F.transform(_filled(text), lambda x: F.struct(F.xxhash64(x["line"]).alias("a"), F.xxhash64(F.lit("second"), x["line"]).alias("b"))).alias("hs"),
    )
    hashed = hashed.where(F.size("hs") >= width)

    def window(i: Column) -> Column:
        part = [F.get("hs", i + k) for k in range(width)]
        return F.struct(F.xxhash64(*[p["a"] for p in part]).alias("h1"), F.xxhash64(*[p["b"] for p in part]).alias("h2"))

    made = F.transform(F.sequence(F.lit(0), F.size("hs") - width), window)
    return hashed.select("who", F.posexplode(made).alias("k", "w")).select("w.h1", "w.h2", "who", "k")


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the text less its repeated lines, n_lines before and n_removed."""
    docs = without(docs, ["n_lines", "n_removed"])
    found = spill(windows(docs, width))
    repeated = found.groupBy("h1", "h2").agg(F.min(F.struct("who", "k")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = found.join(repeated, ["h1", "h2"]).where(F.struct("who", "k") != F.col("first"))
    covered = later.groupBy(F.col("who").alias("_lines_who")).agg(F.collect_set("k").alias("_lines_later"))

    def places(ks: Column) -> Column:
        return F.flatten(F.transform(ks, lambda k: F.slice(F.col("_lines_at"), k + 1, F.lit(width))))

    text = F.col("text")
    joined = docs.withColumn("_lines_id", _who(text)).join(covered.hint("shuffle_hash"), F.col("_lines_id") == F.col("_lines_who"), "left")
    touched = F.col("_lines_later").isNotNull()
    gone = F.array_distinct(places(F.col("_lines_later")))
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_lines_gone"))
    return (
        joined.withColumn("_lines_at", F.when(touched, F.transform(_filled(text), lambda x: x["at"])))
        .withColumn("_lines_gone", F.when(touched, gone))
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)))
        .withColumn("n_removed", F.coalesce(F.size("_lines_gone"), F.lit(0)))
        .withColumn("n_lines", F.when(text.isNull(), F.lit(0)).otherwise(F.col("n_lines")))
        .withColumn("n_removed", F.when(touched, F.col("n_removed")).otherwise(F.lit(0)))
        .withColumn("text", F.when(F.col("n_removed") > 0, F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")).otherwise(text))
        .drop("_lines_id", "_lines_who", "_lines_later", "_lines_at", "_lines_gone")
    )
