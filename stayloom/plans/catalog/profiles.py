"""Null profiles, summaries, counts, quantiles, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import carried, profile
from ...session import load, written
from .base import rounded

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


HOLES_SQL = """
holes AS (
  SELECT l_orderkey, nullif(l_quantity, 1) AS l_quantity, nullif(l_discount, 0) AS l_discount,
         nullif(l_tax, 0) AS l_tax, nullif(l_returnflag, 'N') AS l_returnflag, l_extendedprice
  FROM lineitem)
"""


def holes(spark, d):
    """Line items with NULLs made from the smallest values, as the test tables have none."""
    line = load(spark, d, "lineitem")
    return line.select(
        "l_orderkey", F.nullif("l_quantity", F.lit(1.0)).alias("l_quantity"),
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"), "l_extendedprice")


_COLUMNS = ["l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice"]


@query(f"WITH {HOLES_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 9) AS null_percentage FROM holes" for c in _COLUMNS))
def null_profile(spark, d):
    return rounded(profile.null_profile(holes(spark, d)), 9, "null_percentage")


@query(f"""WITH {HOLES_SQL}
SELECT count(*) AS n_rows, count(*) - count(l_tax) AS n_null,
       round((count(*) - count(l_tax)) / count(*), 9) AS null_share FROM holes""")
def row_and_null_count(spark, d):
    return rounded(profile.row_and_null_count(holes(spark, d), "l_tax"), 9, "null_share")


_NUMBERS = ["l_quantity", "l_discount", "l_tax"]


def _summary_sql(quantiles: dict[str, float]) -> str:
    q = "".join(f", round(quantile_cont({{c}}, {p}), 6) AS {n}" for n, p in quantiles.items())
    one = ("SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, "
           "round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max" + q + " FROM holes")
    return f"WITH {HOLES_SQL} " + " UNION ALL ".join(one.format(c=c) for c in _NUMBERS)


@query(_summary_sql(profile.QUARTILES))
def summary_stats(spark, d):
    return rounded(profile.summary(holes(spark, d), _NUMBERS), 6, "mean", "std", *profile.QUARTILES)


@query(_summary_sql(profile.REPORT_PERCENTILES))
def summary_percentiles(spark, d):
    table = profile.summary(holes(spark, d), _NUMBERS, profile.REPORT_PERCENTILES)
    return rounded(table, 6, "mean", "std", *profile.REPORT_PERCENTILES)


@query(f"WITH {HOLES_SQL} SELECT l_returnflag, count(*) AS n FROM holes WHERE l_returnflag IS NOT NULL GROUP BY 1")
def value_counts(spark, d):
    return profile.value_counts(holes(spark, d), "l_returnflag")


@query("SELECT count(DISTINCT p_brand) AS n_categories FROM part")
def category_count(spark, d):
    return profile.category_count(load(spark, d, "part"), "p_brand")


@query("""
WITH b AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 80 AS w FROM events),
c AS (SELECT least(floor((value - lo) / w), 79)::INTEGER AS bin, count(*) AS n FROM events, b GROUP BY 1)
SELECT i::INTEGER AS bin, round(lo + i * w, 6) AS left_edge, round(lo + (i + 1) * w, 6) AS right_edge,
       coalesce(n, 0) AS n
FROM range(80) r(i) CROSS JOIN b LEFT JOIN c ON c.bin = i""")
def histogram(spark, d):
    return rounded(profile.histogram(load(spark, d, "events"), "value", 80), 6, "left_edge", "right_edge")


@query("""
WITH c AS (SELECT least(floor((value - 0) / (200.0::DOUBLE / 60)), 59)::INTEGER AS bin, count(*) AS n
           FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1)
SELECT i::INTEGER AS bin, round(i * (200.0::DOUBLE / 60), 6) AS left_edge,
       round((i + 1) * (200.0::DOUBLE / 60), 6) AS right_edge, coalesce(n, 0) AS n
FROM range(60) r(i) LEFT JOIN c ON c.bin = i""")
def histogram_fixed_range(spark, d):
    return rounded(profile.histogram(load(spark, d, "events"), "value", 60, 0, 200), 6, "left_edge", "right_edge")


@query("""
SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 6) AS q25,
       round(quantile_cont(o_totalprice, 0.5), 6) AS q50, round(quantile_cont(o_totalprice, 0.75), 6) AS q75
FROM orders GROUP BY 1""")
def group_quartiles(spark, d):
    table = profile.group_quartiles(load(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(table, 6, "q25", "q50", "q75")


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def filtered_count(spark, d):
    return load(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").agg(
        F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT trim(p_name) AS p_name FROM part WHERE p_name IS NOT NULL")
def distinct_text(spark, d):
    return profile.distinct_text(load(spark, d, "part"), "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_rows(spark, d):
    return profile.top_rows(load(spark, d, "orders"), "o_totalprice", 50, ties=["o_orderkey"]).select(
        "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def shuffled_rows(spark, d):
    """Row order within partitions is random, the rows are the same."""
    line = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return profile.shuffled_within_partitions(line)


@query("""
SELECT feature, count(*) AS n, count(*) - count(x) AS nulls, round(avg(x), 8) AS mean, round(stddev_samp(x), 8) AS std,
       min(x) AS low, max(x) AS high
FROM (SELECT 'l_quantity' AS feature, nullif(l_quantity, 1)::DOUBLE AS x FROM lineitem
      UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_tax', nullif(l_tax, 0) FROM lineitem)
GROUP BY 1""")
def profile_carried(spark, d):
    """Counts, moments and range of seven loads, one for each year of shipping, from their stored states alone."""
    rows = load(spark, d, "lineitem").select(
        F.nullif("l_quantity", F.lit(1)).alias("l_quantity"), "l_extendedprice", F.nullif("l_tax", F.lit(0)).alias("l_tax"), F.year("l_shipdate").alias("year"))
    columns = ["l_quantity", "l_extendedprice", "l_tax"]
    years = sorted(r[0] for r in rows.select("year").distinct().collect())
    state = written(carried.profile_state(rows.filter(F.col("year") == years[0]), columns), "state")
    for year in years[1:]:
        load_state = carried.profile_state(rows.filter(F.col("year") == year), columns)
        state = written(carried.merged_state(state.unionByName(load_state)), "state")
    return rounded(carried.read_profile(state).select("feature", "n", "nulls", "mean", "std", "low", "high"), 8, "mean", "std")


@query("""
SELECT column_name AS feature, CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') OR column_type LIKE 'DECIMAL%' THEN 'numeric'
       WHEN column_type = 'VARCHAR' THEN 'category' ELSE 'other' END AS kind, (SELECT count(*) FROM orders) AS n
FROM (DESCRIBE orders)""")
def columns_by_type(spark, d):
    """Kinds of the columns of a table, each with its number of rows with a value."""
    orders = load(spark, d, "orders")
    kind = {c: "numeric" for c in profile.numeric_columns(orders)} | {c: "category" for c in profile.categorical_columns(orders)}
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(kind.get(c, "other")).alias("kind"), F.count(c).alias("n")) for c in orders.columns])
    return orders.agg(entries.alias("e")).select(F.explode("e").alias("e")).select("e.*")


@query("SELECT least(5, count(*)) AS n_rows, least(5, count(*)) AS n_known FROM lineitem")
def preview_rows(spark, d):
    """Any five rows, all of them rows of the table."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    some = written(profile.preview(lines, 5), "preview")
    known = lines.join(F.broadcast(some), ["l_orderkey", "l_linenumber", "l_extendedprice"], "left_semi")  # five rows
    return some.agg(F.count(F.lit(1)).alias("n_rows")).join(F.broadcast(known.agg(F.count(F.lit(1)).alias("n_known"))))
