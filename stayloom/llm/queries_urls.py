"""Query op9 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import load
from .urls import judge

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def url_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return judge(load(spark, d, "pages").select("page_id", "url"), RULES)


URLS_SQL = r"""
WITH read AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
         row_number() OVER () AS line
  FROM pages),
list(verdict, rule, h, p) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
  ('block', 'com/de/', 'com', '/de/')),
listed AS (
  SELECT line, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM read JOIN list ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY line),
cut AS (
  SELECT r.*, l.rule, l.verdict,
         list_distinct(
           list_transform(list_filter(string_split_regex(host, '[.-]'), lambda x: x <> ''), lambda x: 'host:' || x)
           || list_transform(list_filter(string_split_regex(path, '[/._-]'),
                                         lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')), lambda x: 'path:' || x)) AS tokens
  FROM read r LEFT JOIN listed l ON r.line = l.line),
least AS (SELECT ceil(0.005 * count(*)) AS n FROM cut WHERE verdict IS NOT NULL),
part AS (
  SELECT line, verdict, t FROM (SELECT line, verdict, unnest(tokens) AS t FROM cut WHERE verdict IS NOT NULL)
  WHERE t IN (SELECT t FROM (SELECT unnest(tokens) AS t FROM cut WHERE verdict IS NOT NULL)
              GROUP BY t HAVING count(*) >= (SELECT n FROM least))),
sets AS (
  SELECT line, verdict, [t] AS needs FROM part
  UNION ALL
  SELECT a.line, a.verdict, [a.t, b.t] FROM part a JOIN part b ON a.line = b.line AND a.t < b.t
  UNION ALL
  SELECT a.line, a.verdict, [a.t, b.t, c.t]
  FROM part a JOIN part b ON a.line = b.line AND a.t < b.t JOIN part c ON a.line = c.line AND b.t < c.t),
alone AS (SELECT needs, count(*) AS with_any FROM sets GROUP BY needs),
rules AS (
  SELECT s.needs, s.verdict, count(*) AS support, count(*)::DOUBLE / any_value(with_any) AS confidence
  FROM sets s JOIN alone a ON s.needs = a.needs
  GROUP BY s.needs, s.verdict
  HAVING count(*) >= (SELECT n FROM least) AND count(*)::DOUBLE / any_value(with_any) >= 0.8),
met AS (
  SELECT c.line, r.verdict, array_to_string(r.needs, '|') AS reason
  FROM cut c JOIN rules r ON list_has_all(c.tokens, r.needs)
  WHERE c.verdict IS NULL
  QUALIFY row_number() OVER (
    PARTITION BY c.line ORDER BY r.confidence DESC, r.support DESC, len(r.needs), array_to_string(r.needs, '|'), r.verdict) = 1)
SELECT c.page_id, c.host, c.path, c.rule, coalesce(c.verdict, m.verdict, 'allow') AS verdict, m.reason
FROM cut c LEFT JOIN met m ON c.line = m.line
"""

QUERIES = {"op9_urls": url_verdicts}
ORACLES = {"op9_urls": URLS_SQL}
