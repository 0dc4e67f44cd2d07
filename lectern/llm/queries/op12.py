"""Interaction of five filters on all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.filteraudit import audit
from lectern.llm.queries.common import documents
from lectern.llm.runtime import described


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    with described(spark, f"filter audit of {sf_dir}/documents.parquet with {sf_dir}/labels.parquet"):
        return audit(documents(spark, sf_dir).select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


query = op12_filter_interaction
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e FROM d
), g AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT w.part, coalesce(g.good, false) AS good, coalesce(g.toxic, false) AS toxic,
         CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN e THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN g USING (doc_id)
), m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step::INTEGER AS step, substr(filter_order, step::INTEGER, 1) AS filter, (1 << (strpos('ABCDE', substr(filter_order, step::INTEGER, 1)) - 1))::INTEGER AS bit,
         list_sum([0] || list_transform(range(1, step), lambda j: 1 << (strpos('ABCDE', substr(filter_order, j::INTEGER, 1)) - 1)))::INTEGER AS before
  FROM o, range(1, 6) AS r(step)
), r AS (
  SELECT m.part, filter_order, step, filter,
         sum(n) FILTER ((mask & bit) = 0 AND (mask & before) = 0) AS kept, sum(n) FILTER ((mask & bit) > 0 AND (mask & before) = 0) AS removed,
         sum(n) FILTER ((mask & bit) > 0 AND (mask & before) > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
         sum(good) FILTER ((mask & bit) > 0 AND (mask & before) = 0) AS good_lost, sum(toxic) FILTER ((mask & bit) > 0 AND (mask & before) = 0) AS toxic_lost
  FROM m, s GROUP BY m.part, filter_order, step, filter
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley
FROM r
"""
