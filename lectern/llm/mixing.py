"""Mixing sources to target weights: Efraimidis-Spirakis sampling without replacement, DataFrame functions only.

Every document gets an exponential key ``-ln(u) / w`` where ``u`` is drawn from a digest of its id and the seed and
``w`` is its quality weight; ascending keys give a weighted sample without replacement.  A source whose target is at
least its size is taken whole that many times first (complete epochs); only the rest of its target is filled from the
head of the key order.

The order within a source is never sorted in one task.  Keys are dealt into intervals by their logarithm, ``buckets`` to a
factor of e, so that none holds more than a small share of a source whatever the scale of its weights; the sizes of the
intervals are summed first, a prefix sum over the intervals of each source finds the one in which the budget ends, and
only the documents of that interval are ordered.  A third of all rows in one source therefore costs a partial
aggregate, not a sort of that source.

Edge cases: null or blank texts have size 0 and are taken 0 times in words; a null source is a source of its own, last
in order; null or non-positive weights count as the smallest weight; repeated ids draw equal keys and are ordered by
text digest, and rows equal in both are taken together; an empty table gives an empty result; other columns pass
through and may carry any name except those the operator adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.runtime import WORD_PATTERN, cut, spill, without

LEAST_WEIGHT = 1e-3
#: An interval holds at most 1 / (e BUCKETS) of the documents of one weight.
BUCKETS = 1024
#: The plan, one narrow row a source, is broadcast up to this many sources and shuffled beyond.
MOST_BROADCAST_SOURCES = 20_000
#: Source weights in order of the sources' code points, repeating.
CYCLE = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, falling to 0.25 as half of the characters are symbols."""
    symbols = F.length(text) - F.length(F.translate(text, "#$%&*!|{}<>\\^~=", ""))
    share = F.coalesce(symbols.cast("double") / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))
    return F.lit(1.0) - F.lit(1.5) * F.least(share, F.lit(0.5))


def uniform_key(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, share: float = 1.5, most_epochs: int = 2, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """(source, source_size) -> also weight and target, one row per source.

    The total, ``share`` of all sizes, is dealt by weight; a source stops at ``most_epochs`` times its size and what
    it cannot use goes to the others by weight.  Sorting by size per weight makes the fixed point a prefix sum.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), place + 1)
    cap = (F.col("source_size") * most_epochs).cast("double")
    table = sizes.withColumn("weight", weight.cast("double")).withColumn("_mix_cap", cap)
    rising = Window.orderBy(F.col("_mix_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    table = table.withColumn("_mix_level", level).withColumn("_mix_open", F.col("_mix_cap") / F.col("weight") >= F.col("_mix_level"))
    table = table.withColumn("_mix_step", F.row_number().over(rising))
    flat = F.min(F.when(F.col("_mix_open"), F.struct("_mix_step", "_mix_level"))).over(everything)["_mix_level"]
    return table.withColumn("target", F.when(flat.isNull(), F.col("_mix_cap")).otherwise(F.least(F.col("_mix_cap"), flat * F.col("weight")))).select("source", "source_size", "weight", "target")


def mix_sources(
    docs: DataFrame,
    weight: Column | None = None,
    share: float = 1.5,
    most_epochs: int = 2,
    seed: int = 20,
    buckets: int = BUCKETS,
    cycle: tuple[int, ...] = CYCLE,
) -> DataFrame:
    """Adds size, source_size, target, epochs, sampled (also taken by the fractional part), copies and taken.

    ``docs`` needs doc_id, text and source.  A document at the end of a budget is taken if that brings its source's
    sum nearer to the target.
    """
    docs = without(docs, ["size", "source_size", "target", "epochs", "sampled", "copies", "taken"])
    w = F.greatest(F.coalesce(F.nanvl(weight if weight is not None else quality_weight(F.col("text")), F.lit(0.0)), F.lit(0.0)), F.lit(LEAST_WEIGHT))
    place = F.struct(
        (-F.log(uniform_key(F.col("doc_id"), seed)) / w).alias("key"), F.col("doc_id").alias("id"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("tie")
    )
    bucket = F.floor(F.log(F.col("_mix_place.key")) * buckets)
    keyed = spill(docs.select("source", word_count(F.col("text")).alias("size"), place.alias("_mix_place")).withColumn("_mix_bucket", bucket))
    per_bucket = keyed.groupBy("source", "_mix_bucket").agg(F.sum("size").alias("_mix_words"))
    targets = source_targets(per_bucket.groupBy("source").agg(F.sum("_mix_words").alias("source_size")), share, most_epochs, cycle)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = targets.withColumn("epochs", whole).withColumn("_mix_rest", F.col("target") - F.col("epochs") * F.col("source_size"))

    before = Window.partitionBy("source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        per_bucket.withColumn("_mix_before", F.coalesce(F.sum("_mix_words").over(before), F.lit(0)))
        .join(plan.select(F.col("source").alias("_mix_s"), "_mix_rest"), F.col("source").eqNullSafe(F.col("_mix_s")))
        .where((F.col("_mix_before") <= F.col("_mix_rest")) & (F.col("_mix_before") + F.col("_mix_words") > F.col("_mix_rest")))
        .select(F.col("source").alias("_mix_s"), F.col("_mix_bucket").alias("_mix_end"), "_mix_before", "_mix_rest")
    )
    within = Window.partitionBy("source").orderBy("_mix_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = (
        keyed.join(ends, F.col("source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_bucket") == F.col("_mix_end")))
        .withColumn("_mix_sum", F.col("_mix_before") + F.sum("size").over(within))
        .where(F.col("_mix_sum") - F.col("size") / 2.0 <= F.col("_mix_rest"))
        .groupBy(F.col("source").alias("_mix_l"))
        .agg(F.max("_mix_place").alias("_mix_last"))
    )
    plan = (
        plan.withColumnRenamed("source", "_mix_p")
        .join(ends.select("_mix_s", "_mix_end"), F.col("_mix_p").eqNullSafe(F.col("_mix_s")), "left")
        .join(last, F.col("_mix_p").eqNullSafe(F.col("_mix_l")), "left")
        .select("_mix_p", "source_size", "target", "epochs", "_mix_end", "_mix_last")
    )
    plan = cut(plan)
    small = F.broadcast(plan) if plan.count() <= MOST_BROADCAST_SOURCES else plan
    sampled = (
        F.when(F.col("_mix_end").isNull() | (F.col("_mix_bucket") > F.col("_mix_end")), F.lit(False))
        .when(F.col("_mix_bucket") < F.col("_mix_end"), F.lit(True))
        .otherwise(F.coalesce(F.col("_mix_place") <= F.col("_mix_last"), F.lit(False)))
    )
    return (
        docs.withColumn("size", word_count(F.col("text")))
        .withColumn("_mix_place", place)
        .withColumn("_mix_bucket", bucket)
        .join(small, F.col("source").eqNullSafe(F.col("_mix_p")))
        .withColumn("sampled", sampled)
        .withColumn("copies", F.col("epochs") + F.col("sampled").cast("bigint"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_mix_place", "_mix_bucket", "_mix_p", "_mix_end", "_mix_last")
    )
