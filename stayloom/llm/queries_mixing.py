"""Query op1 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load, written
from .mixing import mix, words


def mixture(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    mixed = mix(written(docs, "sizes"), size=F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


MIXTURE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-7' || chr(31) || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM per),
filling AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source) AS place,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         sum(source_size) OVER ()::BIGINT AS total
  FROM weighed),
level AS (
  SELECT min_by((1.5::DOUBLE * total - used) / rest, place) AS level
  FROM filling WHERE cap > w * ((1.5::DOUBLE * total - used) / rest)),
targets AS (
  SELECT source, source_size,
         CASE WHEN level IS NULL OR w * level >= cap THEN cap ELSE w * level END AS target
  FROM weighed CROSS JOIN level),
rooms AS (
  SELECT *, target - whole * source_size AS room
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets)),
units AS (
  SELECT source, draw, sum(size)::BIGINT AS size FROM sized GROUP BY source, draw),
ordered AS (
  SELECT u.source, u.draw, u.size, r.room,
         sum(u.size) OVER (PARTITION BY u.source ORDER BY u.draw) AS through
  FROM units u JOIN rooms r ON u.source IS NOT DISTINCT FROM r.source),
prefix AS (
  SELECT source, draw, size, room, through <= room AS fits,
         room - max(CASE WHEN through <= room THEN through ELSE 0 END) OVER (PARTITION BY source) AS gap
  FROM ordered),
nearest AS (
  SELECT source, draw FROM prefix WHERE NOT fits AND abs(gap - size) < gap
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(gap - size), draw) = 1),
again AS (
  SELECT p.source, p.draw, p.fits OR n.draw IS NOT NULL AS again
  FROM prefix p LEFT JOIN nearest n ON p.source IS NOT DISTINCT FROM n.source AND p.draw = n.draw)
SELECT s.doc_id, s.size, r.source_size, r.target, (s.size * (r.whole + a.again::INT))::BIGINT AS taken
FROM sized s
JOIN rooms r ON s.source IS NOT DISTINCT FROM r.source
JOIN again a ON s.source IS NOT DISTINCT FROM a.source AND s.draw = a.draw
"""

QUERIES = {"op1_mixture": mixture}
ORACLES = {"op1_mixture": MIXTURE_SQL}
