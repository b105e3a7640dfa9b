"""Query op5 and its SQL: all pairs that share a shingle, which the test tables are small enough for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import load
from .minhash import near_duplicates


def near_duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(load(spark, d, "documents"), size=2, percent=80)


NEAR_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 1 THEN w
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM cut WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sized AS (SELECT s.doc_id, hash(s.s) AS s, n FROM shingles s JOIN sizes z ON s.doc_id = z.doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u),
lowest AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
SELECT c.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(c.doc_id, l.v) AS component_id,
       c.doc_id = least(c.doc_id, l.v) AS kept
FROM cut c LEFT JOIN sizes z ON c.doc_id = z.doc_id LEFT JOIN lowest l ON c.doc_id = l.u
"""

QUERIES = {"op5_near_duplicates": near_duplicate_documents}
ORACLES = {"op5_near_duplicates": NEAR_SQL}
