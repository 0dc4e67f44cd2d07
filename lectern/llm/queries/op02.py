"""Line deduplication of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.linededup import dedup_lines
from lectern.llm.queries.common import documents


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))


query = op2_line_dedup
SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS spot FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM l
), f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) - 1 AS k FROM t WHERE t <> ''
), w AS (
  SELECT doc_id, k, t AS a, lead(t, 1) OVER o AS b, lead(t, 2) OVER o AS c, spot AS i, lead(spot, 1) OVER o AS j, lead(spot, 2) OVER o AS m FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY k)
), o AS (
  SELECT *, row_number() OVER p AS nth, count(*) OVER (PARTITION BY a, b, c) AS n FROM w WHERE c IS NOT NULL WINDOW p AS (PARTITION BY a, b, c ORDER BY doc_id NULLS FIRST, k)
), s AS (
  SELECT doc_id, unnest([i, j, m]) AS spot, nth > 1 AS later FROM o WHERE n > 1
), g AS (
  SELECT doc_id, spot FROM s GROUP BY ALL HAVING bool_or(later)
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.spot) FILTER (g.spot IS NULL) AS text, count(*)::INTEGER AS n_lines, count(g.spot)::INTEGER AS n_removed
  FROM l LEFT JOIN g USING (doc_id, spot) GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
