"""Query op13 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import load, written
from .trie import NODE, end_digests, trie

SHARE = 20  # conversations that take their first turns from one
HEADS = 4


def with_shared_heads(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations of the query: each begins like the one whose id is the next lower multiple of SHARE.

    The first turns, crc32 of the id modulo HEADS in number or as many as there are, replace as many of its own.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % HEADS
    base = F.col("conv_id") - F.col("conv_id") % SHARE
    turn = F.struct("place", "x", "y", "words")
    heads = placed.filter((F.col("conv_id") % SHARE == 0) & (F.col("place") < HEADS - 1)).groupBy(
        F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("base", base)
    plan = written(lookup_join(convs, written(heads, "heads"), ["base"], "left").select(
        "conv_id", "own", "turns", head.alias("head")).withColumn("kept", F.least("head", F.coalesce(F.size("turns"), F.lit(0)))), "plan")
    taken = plan.filter("kept > 0").select("conv_id", F.explode(F.expr("slice(turns, 1, cast(kept as int))")).alias("t")).select(
        "conv_id", "t.*")
    moved = plan.filter("kept < head").select("conv_id", (F.col("kept") - F.col("head")).alias("shift"))
    rest = lookup_join(placed.filter(F.col("place") >= head), moved, ["conv_id"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"), "x", "y", "words")
    return rest.unionByName(taken), plan.filter("kept = 0 AND own <= head").select("conv_id")


def conversation_trie(spark: SparkSession, d: str) -> DataFrame:
    nodes, ends = trie(load(spark, d, "conversations"), with_shared_heads)
    alone = F.when(F.col("n_ends") > 0, F.col("conv_id").cast("string")).otherwise(F.lit(""))
    shared = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return nodes.filter("single").select(*columns, F.sha2(alone, 256).alias("ends_sha256")).unionByName(
        nodes.filter(~F.col("single")).join(end_digests(ends), NODE, "left").select(*columns, shared.alias("ends_sha256")))


TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           md5(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
      lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.place, t.m, t.words FROM convs c JOIN turns t ON c.base = t.conv_id AND t.place < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.m, t.words FROM convs c JOIN turns t ON c.conv_id = t.conv_id AND t.place >= c.h),
paths AS (
  SELECT conv_id, row_number() OVER w AS depth, words, string_agg(m, '') OVER w AS path,
         lead(1) OVER w IS NULL AS last
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM paths GROUP BY path, depth),
children AS (
  SELECT left(path, len(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.path = c.path),
below AS (
  SELECT left(path, 32 * k) AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM full_nodes) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved AS saved_tokens,
       sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN below b ON n.path = b.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, len(n.path) - 32)
"""

QUERIES = {"op13_trie": conversation_trie}
ORACLES = {"op13_trie": TRIE_SQL}
