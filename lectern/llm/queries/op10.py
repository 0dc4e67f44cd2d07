"""Mixture of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.mixing import mix_sources
from lectern.llm.queries.common import documents


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


query = op10_mix_sources
SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':20'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u,
         1.0::DOUBLE - 1.5::DOUBLE * least(coalesce((length(text) - length(translate(text, '#$%&*!|{}<>\^~=', '')))::DOUBLE / greatest(length(text), 1), 0.0), 0.5::DOUBLE) AS w
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, ([5, 2, 1])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS cap FROM s
), r AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER o AS step
  FROM n WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), f AS (
  SELECT min_by(level, step) FILTER (cap / weight >= level) AS flat FROM r
), t AS (
  SELECT source, source_size, CASE WHEN flat IS NULL THEN cap ELSE least(cap, flat * weight) END AS target FROM r, f
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t
), k AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / greatest(w, 0.001::DOUBLE), d.doc_id, md5(d.text) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size / 2.0::DOUBLE AS middle
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (epochs + CASE WHEN middle <= rest AND rest > 0 THEN 1 ELSE 0 END) * size AS taken,
       epochs + CASE WHEN middle <= rest AND rest > 0 THEN 1 ELSE 0 END AS copies
FROM k
"""
