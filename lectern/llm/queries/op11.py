"""Verdicts on the URLs of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.urlrules import judge

#: The stated rules: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)


query = op11_url_filters
#: Combinations of up to three tokens, counted one by one.
SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), t AS (
  SELECT page_id, host, path, list_sort(list_distinct(
    list_transform(list_filter(list_transform(list_reverse(string_split(host, '.')), lambda x, i: {'x': x, 'i': i - 1}), lambda s: s.x <> ''), lambda s: 'h' || s.i || '=' || s.x)
    || list_transform(list_filter(flatten(list_transform(list_filter(string_split(host, '.'), lambda x: contains(x, '-')), lambda x: string_split(x, '-'))), lambda x: x <> ''), lambda x: 'w=' || x)
    || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p=' || regexp_replace(x, '[0-9]+', '#', 'g'))
    || list_transform(list_filter(list_transform(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '^[^=]*', 0)), lambda x: x <> ''), lambda x: 'q=' || regexp_replace(x, '[0-9]+', '#', 'g'))
    || CASE WHEN contains(rest, '#') THEN ['f=' || regexp_replace(regexp_extract(rest, '#([^#]*)', 1), '[0-9]+', '#', 'g')] ELSE [] END)) AS tokens
  FROM p
), l AS (
  SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS l(h, s, v)
), r AS (
  SELECT t.page_id, max_by(l.h || l.s, length(l.h || l.s)) AS rule, max_by(l.v, length(l.h || l.s)) AS verdict
  FROM t JOIN l ON (t.host = l.h OR ends_with(t.host, '.' || l.h)) AND starts_with(t.path, l.s) GROUP BY t.page_id
), j AS (
  SELECT t.*, r.rule, r.verdict FROM t LEFT JOIN r USING (page_id)
), k AS (
  SELECT page_id, verdict AS label, tokens FROM j WHERE verdict IS NOT NULL
), c AS (
  SELECT count(*) AS n, greatest(5, ceil(0.001::DOUBLE * count(*)))::BIGINT AS floor FROM k
), m AS (
  SELECT label FROM k GROUP BY label ORDER BY count(*) DESC, label LIMIT 1
), e AS (
  SELECT page_id, label, unnest(tokens) AS token FROM k
), f AS (
  SELECT token FROM e, c GROUP BY token, c.n, c.floor HAVING count(*) BETWEEN c.floor AND 0.95::DOUBLE * c.n
), g AS (
  SELECT e.* FROM e SEMI JOIN f USING (token)
), s AS (
  SELECT label, [token] AS items FROM g
  UNION ALL SELECT a.label, [a.token, b.token] FROM g a JOIN g b ON a.page_id = b.page_id AND a.token < b.token
  UNION ALL SELECT a.label, [a.token, b.token, d.token] FROM g a JOIN g b ON a.page_id = b.page_id AND a.token < b.token JOIN g d ON a.page_id = d.page_id AND b.token < d.token
), n AS (
  SELECT items, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY items) AS total FROM s GROUP BY items, label
), x AS (
  SELECT n.items, n.label, n.n, n.n::DOUBLE / n.total AS confidence FROM n, c WHERE n.n >= c.floor AND n.n::DOUBLE / n.total >= 0.7::DOUBLE
), b AS (
  SELECT j.page_id, x.label, x.confidence, array_to_string(x.items, ' ') AS because
  FROM j JOIN x ON list_has_all(j.tokens, x.items) WHERE j.verdict IS NULL
  QUALIFY row_number() OVER (PARTITION BY j.page_id ORDER BY x.confidence DESC, x.n DESC, len(x.items), array_to_string(x.items, ' '), x.label) = 1
)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.verdict, b.label, (SELECT label FROM m), 'allow') AS verdict, b.confidence, b.because
FROM j LEFT JOIN b USING (page_id)
"""
