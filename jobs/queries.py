"""The jobs as queries: each runs twice on the whole tables into one new folder and gives its whole output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import chat_ledger, ingest_passages
from lectern.plans import catalogue
from lectern.shared import new_folder


def job1_ingest_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")
    config = ingest_passages.Config(f"{sf_dir}/documents.parquet", f"{folder}/passages", f"{folder}/checkpoint")
    for _ in range(2):
        ingest_passages.run(spark, config)
    return ingest_passages.current(ingest_passages.read_output(spark, config.output)).drop("version")


def job2_chat_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    config = chat_ledger.Config(f"{sf_dir}/events.parquet", f"{folder}/ledger", catalogue.CHAT_LIMIT, catalogue.CHAT_LONGEST, catalogue.CHAT_CAP, catalogue.CHAT_HOURS * 3600.0)
    for _ in range(2):
        chat_ledger.run(spark, config)
    return chat_ledger.read_output(spark, config.output)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_ingest_passages, job2_chat_ledger)}
SQL = {
    "job1_ingest_passages": f"""{catalogue.chunks_sql()} SELECT k.doc_id, d.lang, s::INTEGER AS start, e::INTEGER AS "end", len(k.text)::INTEGER AS n_chars, sha256('e5' || chr(0) || 'passage: ' || k.text) AS key, k.text, d.source
FROM k JOIN documents d USING (doc_id)""",
    "job2_chat_ledger": f"""{catalogue.VERDICTS_SQL}, v AS (
  SELECT ev.chat_id, ev.cost_usd, verdict, make_timestamp(round(ev.t * 1e6)::BIGINT)::DATE AS day FROM verdicts JOIN ev USING (chat_id, seq)
), d AS (
  SELECT chat_id, day, count(*) AS n_messages, count(*) FILTER (verdict = 'ok') AS n_ok, count(*) FILTER (verdict = 'rate_limited') AS n_rate_limited, count(*) FILTER (verdict = 'too_long') AS n_too_long,
         count(*) FILTER (verdict = 'over_budget') AS n_over_budget, round(coalesce(sum(cost_usd) FILTER (verdict = 'ok'), 0.0), 6) AS cost_usd FROM v GROUP BY chat_id, day
)
SELECT *, round(sum(cost_usd) OVER (PARTITION BY chat_id ORDER BY day), 6) AS cost_to_date FROM d""",
}
