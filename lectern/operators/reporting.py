"""Reports over judged answers: latest record of each question, accuracy, refusals and cost by configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import dollars, percent


def latest(rows: DataFrame, order: Column | str, *keys: str) -> DataFrame:
    """The last row of each key by ``order``: one aggregate with map-side combining, no sort of the groups."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), order if isinstance(order, Column) else F.col(order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*rows.columns)


def config_report(records: DataFrame) -> DataFrame:
    """(config, answerable, verdict, cost_usd) -> one row a config; records without a verdict are left out."""
    judged = records.where("verdict is not null")
    answerable, verdict, money = F.col("answerable"), F.col("verdict"), F.coalesce(F.col("cost_usd"), F.lit(0.0))
    count = lambda c: F.count_if(c)
    share = lambda a, b: F.coalesce(F.try_divide(count(a).cast("double"), count(b)), F.lit(0.0))
    return judged.groupBy("config").agg(
        F.count("*").alias("n"),
        share(answerable & (verdict == "correct"), answerable).alias("accuracy"),
        share(~answerable & (verdict == "refused"), ~answerable).alias("honest_refusals"),
        share(answerable & (verdict == "refused"), answerable).alias("false_refusals"),
        F.round(F.sum(money) / F.count("*"), 9).alias("cost_per_question"),
        F.round(F.try_divide(F.sum(money), count(answerable & (verdict == "correct"))), 9).alias("cost_per_correct"),
    )


def presented(report: DataFrame, order: list[str]) -> DataFrame:
    """Rows of the configs in ``order``, in that order, as texts."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("config"))
    rows = report.where(F.col("config").isin(*order)).orderBy(place)
    return rows.select(
        "config", percent(F.col("accuracy")).alias("accuracy"), dollars(F.col("cost_per_question")).alias("cost_per_question"), dollars(F.col("cost_per_correct")).alias("cost_per_correct"),
        F.format_string("%.0f", F.bround(F.col("honest_refusals") * 10)).alias("refused_of_10"), F.format_string("%.0f", F.bround(F.col("false_refusals") * 40)).alias("refused_of_40"),
    )


#: Configurations are named in the plan; more of them are an error.
MOST_CONFIGS = 10_000


def unfinished(configs: DataFrame, questions: DataFrame, done: DataFrame) -> DataFrame:
    """(config, qid) pairs that are still to be answered: every question under every one of a few configurations."""
    names = [r["config"] for r in configs.select("config").limit(MOST_CONFIGS + 1).collect()]
    if len(names) > MOST_CONFIGS:
        raise ValueError(f"more than {MOST_CONFIGS} configurations")
    kind = f"array<{dict(configs.dtypes)['config']}>"
    asked = questions.select(F.explode(F.array(*[F.lit(x) for x in names]).cast(kind)).alias("config"), "qid")
    return asked.join(done.select("config", "qid").distinct(), ["config", "qid"], "left_anti")


def recall_lines(report: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(place, line): a report of recall by source as lines of fixed width, a heading first, then vector, words, hybrid."""
    order = F.array(*[F.lit(x) for x in ("vector", "words", "hybrid")])
    head = report.sparkSession.createDataFrame([(0, f"{'source':<10} " + " ".join(f"{f'@{k}':>8}" for k in ks))], "place int, line string")
    cells = [F.format_string("%8.3f", F.col(f"recall_{k}")) for k in ks]
    rows = report.select(F.array_position(order, F.col("source")).cast("int").alias("place"), F.concat_ws(" ", F.rpad("source", 10, " "), *cells).alias("line"))
    return head.unionByName(rows.where("place > 0")).orderBy("place")


def usage_totals(replies: DataFrame, *keys: str) -> DataFrame:
    """Replies (prompt_tokens, completion_tokens, cost_usd) -> calls, tokens and cost, by ``keys``; nulls count as nothing."""
    total = lambda c, kind: F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c)
    return replies.groupBy(*keys).agg(F.count("*").alias("calls"), total("prompt_tokens", "long"), total("completion_tokens", "long"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))


def with_verdicts(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Fills missing verdicts from a cache (config, qid, verdict)."""
    known = cache.select("config", "qid", F.col("verdict").alias("_cached"))
    return records.join(known, ["config", "qid"], "left").withColumn("verdict", F.coalesce("verdict", "_cached")).drop("_cached")


def head_of_each(questions: DataFrame, limit: int, order: str = "id") -> DataFrame:
    """The first ``limit`` answerable questions and a quarter as many, at least one, of the others; 0 means all."""
    if not limit:
        return questions
    place = F.row_number().over(Window.partitionBy("answerable").orderBy(order))
    most = F.when(F.col("answerable"), limit).otherwise(max(1, limit // 4))
    return questions.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def with_costs(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd from (model, prompt_tokens, completion_tokens) and (model, prompt, completion); unknown models cost 0."""
    from lectern.functions.text import cost

    joined = rows.join(prices.select("model", F.col("prompt").alias("_p"), F.col("completion").alias("_c")), "model", "left")
    return joined.withColumn("cost_usd", cost(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("_p"), F.col("_c"))).drop("_p", "_c")
