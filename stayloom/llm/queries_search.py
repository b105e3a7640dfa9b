"""Query op8 and its SQL: the search is exact at factor one, so brute force must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import load
from .search import nearest


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = load(spark, d, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20, factor=1.0)


NEAREST_SQL = """
WITH able AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM able q JOIN able c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

QUERIES = {"op8_nearest": nearest_vectors}
ORACLES = {"op8_nearest": NEAREST_SQL}
