"""Query op12 and its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from .common import WORD
from .runs import find_runs


def with_repeats(docs: DataFrame) -> DataFrame:
    """The texts of the query: every tenth document, by the crc32 of its id, goes on with a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    n, g = F.size("words"), F.floor(h / 10)
    a = F.col("a")
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.expr(rf"regexp_extract_all(text, r'{WORD}', 0)")).alias("words"))
    chosen = words.select("doc_id", "text", "words", (F.coalesce(h % 10 == 0, F.lit(False)) & (n > 0)).alias("chosen"),
                          F.when(n > 0, g % n).alias("a"), n.alias("n"), g.alias("g"))
    period = chosen.withColumn("p", F.when(F.col("chosen"), 1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))))
    again = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")
    return period.select("doc_id", F.when(F.col("chosen"), again).otherwise(F.col("text")).alias("text"))


def greatest(runs: Column) -> Column:
    """The run of greatest length to period, ties to smallest start, then period, of runs in that order; exact."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def periodic_documents(spark: SparkSession, d: str) -> DataFrame:
    found = find_runs(with_repeats(load(spark, d, "documents").select("doc_id", "text")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("best")
    return found.withColumn("best", greatest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


# Words 16 and 24: a run of period d has 16 words in both of the equal stretches it consists of, for every d.
RUNS_SQL = r"""
WITH crc AS (
  SELECT doc_id, text, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
      lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) AS h
  FROM documents),
cut AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM crc),
placed AS (SELECT *, len(w0) AS n, CASE WHEN len(w0) > 0 THEN g % len(w0) END AS a FROM cut),
docs AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i:
    CASE WHEN i < a THEN w0[i + 1] ELSE w0[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w0 END AS w
  FROM placed),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM docs WHERE n > 0),
windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS s,
         count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS size
  FROM words),
same AS (
  SELECT a.doc_id, a.i, b.i - a.i AS d FROM windows a JOIN windows b ON a.doc_id = b.doc_id AND a.s = b.s AND a.i < b.i
  WHERE a.size = 16 AND b.size = 16),
stretches AS (
  SELECT doc_id, d, min(i) AS start, count(*) + 15 + d AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS g FROM same)
  GROUP BY doc_id, d, g),
runs AS (
  SELECT doc_id, start, length, min(d) AS period FROM stretches
  WHERE length >= 24 AND length >= 3 * d GROUP BY doc_id, start, length),
lists AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s,
         list({'start': start, 'length': length, 'period': period}) AS r
  FROM runs GROUP BY doc_id),
best AS (
  SELECT doc_id, start, length, period FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
rest AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS s FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i
  GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(l.n_runs, 0) AS n_runs, b.start, b.length, b.period,
       (1000 * b.length) // b.period AS exponent_milli,
       sha256(coalesce(l.s, '')) AS runs_sha256, sha256(coalesce(r.s, '')) AS collapsed_sha256
FROM docs d LEFT JOIN lists l ON d.doc_id = l.doc_id LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN rest r ON d.doc_id = r.doc_id
"""

QUERIES = {"op12_runs": periodic_documents}
ORACLES = {"op12_runs": RUNS_SQL}
