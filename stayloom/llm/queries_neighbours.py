"""Query op4 and its SQL: all pairs of a label, which the test tables are small enough for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import load
from .neighbours import link


def vector_links(spark: SparkSession, d: str) -> DataFrame:
    return link(load(spark, d, "embeddings"), threshold=0.98)


LINKS_SQL = """
WITH RECURSIVE able AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM able a JOIN able b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS v FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, l.v) AS component_id,
       e.vec_id = least(e.vec_id, l.v) AS kept
FROM embeddings e LEFT JOIN counts c ON e.vec_id = c.u LEFT JOIN least l ON e.vec_id = l.u
"""

QUERIES = {"op4_vector_links": vector_links}
ORACLES = {"op4_vector_links": LINKS_SQL}
