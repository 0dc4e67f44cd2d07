"""Near-duplicate documents among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.neardup_text import near_duplicates
from lectern.llm.queries.common import documents


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), width=4, percent=85)


query = op9_ngram_jaccard_join
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 4 THEN w ELSE w[i : i + 3] END) AS s FROM w, unnest(range(1, greatest(2, len(w) - 2))) AS r(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), k AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY list(s ORDER BY s)) AS rep FROM s GROUP BY doc_id
), d AS (
  SELECT s.* FROM s JOIN k USING (doc_id) WHERE doc_id = rep
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r AS (
  SELECT a AS node, a AS seen FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen
), c AS (
  SELECT node, min(seen) AS root FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, k.rep, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN c ON c.node = k.rep
"""
