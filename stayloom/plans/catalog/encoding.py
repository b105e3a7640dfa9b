"""Imputation, categories, ages, fences, scalar transforms, growing category map."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import numbers as num
from ...functions.text import feature_name_column, sanitised
from ...operators import incremental, prepare, profile
from ...session import load, written
from ...sources.readers import nullable_doubles
from ...sources.writers import timestamps_as_text
from .base import STAY_SQL, rounded, stays
from .profiles import HOLES_SQL, holes

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@query(f"""WITH {HOLES_SQL}
SELECT l_orderkey, l_extendedprice, coalesce(l_tax, 0) AS l_tax,
       coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM holes)) AS l_quantity,
       coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM holes)) AS l_discount
FROM holes""")
def impute_zero_median(spark, d):
    df = prepare.fill_zero(holes(spark, d).drop("l_returnflag"), ["l_tax", "not_there"])
    return prepare.MedianImputer.fit(df, ["l_quantity", "l_discount", "not_there"]).transform(df)


@query(f"""WITH {HOLES_SQL}
SELECT l_orderkey, coalesce(l_quantity, 0) AS l_quantity, coalesce(l_discount, 0) AS l_discount,
       coalesce(l_tax, 0) AS l_tax, l_extendedprice FROM holes""")
def fill_remaining(spark, d):
    return prepare.fill_zero(holes(spark, d).drop("l_returnflag"))


@query(f"""WITH {HOLES_SQL}
SELECT l_orderkey, CAST(coalesce(l_returnflag = 'R', false) AS INTEGER) AS l_returnflag_R FROM holes""")
def one_hot_drop_first(spark, d):
    df = holes(spark, d).select("l_orderkey", "l_returnflag")
    return prepare.OneHot.fit(df, ["l_returnflag"], drop_first=True).transform(df)


@query("""
SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS "o_orderpriority_1-URGENT",
       CAST(o_orderpriority = '2-HIGH' AS INTEGER) AS "o_orderpriority_2-HIGH"
FROM orders WHERE o_custkey % 10 >= 8""")
def one_hot_train_schema(spark, d):
    """Categories seen on one side decide the columns of the other; unseen ones are zero everywhere."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    side = orders.filter("o_custkey % 10 < 8 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
    hot = prepare.OneHot.fit(side, ["o_orderpriority"])
    return hot.transform(orders.filter("o_custkey % 10 >= 8")).drop("o_custkey")


@query("""
SELECT o_orderkey, 0 AS missing_column, o_totalprice FROM orders""")
def aligned_columns(spark, d):
    orders = load(spark, d, "orders")
    like = orders.select("o_orderkey", F.lit(1).alias("missing_column"), "o_totalprice")
    return prepare.align_columns(orders, like)


_MAP = [("small ring", "rings"), (" red widget ", "widgets"), ("blue bolt", "fasteners"), ("hot gear", "gears")]


@query("""
SELECT p_partkey, m.category AS p_name FROM part
LEFT JOIN (VALUES ('small ring', 'rings'), ('red widget', 'widgets'), ('blue bolt', 'fasteners'),
                  ('hot gear', 'gears')) AS m(name, category) ON trim(p_name) = m.name""")
def category_map(spark, d):
    mapping = spark.createDataFrame(_MAP, "diagnosis string, category string")
    return prepare.map_category(load(spark, d, "part").select("p_partkey", "p_name"), mapping, "p_name")


@query("""
WITH top AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 5)
SELECT p_partkey, CASE WHEN p_brand IN (FROM top) THEN p_brand ELSE 'OTHER' END AS p_brand FROM part""")
def rare_to_other(spark, d):
    return prepare.rare_to_other(load(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 5)


AGE_SQL = "CAST(trunc(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400) / 365.25) AS INTEGER)"


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, {AGE_SQL} AS age,
       CASE WHEN {AGE_SQL} > 3 THEN 90 ELSE {AGE_SQL} END AS age_capped
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def age_years(spark, d):
    """Whole years between order and shipment; ages over a limit become one value."""
    line = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    age = num.age_years(F.col("l_shipdate"), F.col("o_orderdate"))
    rows = line.join(orders, "l_orderkey").withColumn("age", age)
    return rows.withColumn("age_capped", num.capped_age(F.col("age"), 3, 90)).drop("l_shipdate", "o_orderdate")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, (epoch(l_shipdate) - epoch(o_orderdate)) / 3600 AS hours,
       round(l_quantity / nullif((epoch(l_shipdate) - epoch(o_orderdate)) / 3600, 0), 9) AS per_hour
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def duration_ratio(spark, d):
    line = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    rows = line.join(orders, "l_orderkey").withColumn(
        "hours", num.hours_between(F.col("l_shipdate"), F.col("o_orderdate")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "hours",
                       F.round(num.ratio(F.col("l_quantity"), F.col("hours")), 9).alias("per_hour"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events""")
def timestamps_text(spark, d):
    return timestamps_as_text(load(spark, d, "events").select("event_id", "ts"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / nullif(l_discount, 0), 9) AS shock_index,
       round((l_quantity + 2 * l_tax) / 3, 9) AS map_mean, round(l_quantity - l_tax, 9) AS pulse_pressure
FROM lineitem""")
def derived_vitals(spark, d):
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(num.shock_index(q, disc), 9).alias("shock_index"),
        F.round(num.mean_arterial_pressure(q, tax), 9).alias("map_mean"),
        F.round(num.pulse_pressure(q, tax), 9).alias("pulse_pressure"))


@query("""
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level,
       TRY_CAST(o_orderstatus AS DOUBLE) AS status FROM orders""")
def numeric_coercion(spark, d):
    return load(spark, d, "orders").select(
        "o_orderkey", num.numeric(F.substring("o_orderpriority", 1, 1)).alias("level"),
        num.numeric(F.col("o_orderstatus")).alias("status"))


@query("""
SELECT p_partkey, replace(replace(lower(trim(p_type || '/ ' || p_name || ' (' || p_brand || ')-x')), ' ', '_'), '/', '_')
       .replace('-', '_').replace('(', '').replace(')', '') AS feature FROM part""")
def feature_names(spark, d):
    name = F.concat("p_type", F.lit("/ "), "p_name", F.lit(" ("), "p_brand", F.lit(")-x"))
    return load(spark, d, "part").select("p_partkey", feature_name_column(name).alias("feature"))


@query('SELECT l_orderkey, l_quantity AS l_quantity__kg_, l_tax AS "tax_ _" FROM lineitem')
def sanitised_columns(spark, d):
    df = load(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("l_quantity:[kg]"), F.col("l_tax").alias("tax, %"))
    return sanitised(df)


@query("SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, CAST(n_regionkey AS DOUBLE) AS n_regionkey, n_name FROM nation")
def integers_as_doubles(spark, d):
    return nullable_doubles(load(spark, d, "nation"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def select_existing(spark, d):
    df, _ = prepare.select_existing(load(spark, d, "orders"), ["o_orderkey", "nope", "o_totalprice"])
    return df


@query("SELECT doc_id, toxic FROM labels WHERE quality = 0")
def cohort_filter(spark, d):
    return prepare.cohort_filter(load(spark, d, "labels"), "quality", 0)


@query(f"WITH {HOLES_SQL} SELECT l_orderkey, l_tax, l_discount FROM holes WHERE l_tax IS NOT NULL AND l_discount IS NOT NULL")
def required_columns(spark, d):
    return prepare.require(holes(spark, d), ["l_tax", "l_discount"]).select("l_orderkey", "l_tax", "l_discount")


FENCE_SQL = f"""{STAY_SQL},
target AS (SELECT stay_id, CASE WHEN admission_type = '5-LOW' AND gender = 'P' THEN NULL ELSE los END AS los FROM stays),
fence AS (SELECT greatest(0, quantile_cont(los, 0.25) - 1.5 * (quantile_cont(los, 0.75) - quantile_cont(los, 0.25))) AS lo,
                 quantile_cont(los, 0.99) AS hi FROM target)"""


def _target(spark, d):
    missing = (F.col("admission_type") == "5-LOW") & (F.col("gender") == "P")
    return written(stays(spark, d).select("stay_id", F.when(~missing, F.col("los")).alias("los")), "target")


@query(f"""WITH {FENCE_SQL}
SELECT stay_id, round(los, 9) AS los, round(ln(1 + los), 9) AS los_log FROM target, fence
WHERE los IS NULL OR (los >= lo AND los <= hi)""")
def outlier_fence(spark, d):
    """Rows within the fence and rows without target; log target added."""
    df = _target(spark, d)
    clean = prepare.within_bounds(df, "los", *prepare.outlier_bounds(df, "los"))
    return clean.select("stay_id", F.round("los", 9).alias("los"),
                        F.round(num.log_target(F.col("los")), 9).alias("los_log"))


@query(f"""WITH {FENCE_SQL}
SELECT count(*) FILTER (WHERE los < lo) AS n_low, count(*) FILTER (WHERE los > hi) AS n_high, count(*) AS n_rows
FROM target, fence""")
def outlier_counts(spark, d):
    df = _target(spark, d)
    return prepare.flagged_counts(df, "los", *prepare.outlier_bounds(df, "los"))


@query(f"""WITH {FENCE_SQL}, kept AS (SELECT los FROM target, fence WHERE los IS NULL OR (los >= lo AND los <= hi))
SELECT 'before' AS step, count(*) AS n_rows, round(median(los), 6) AS median, round(avg(los), 6) AS mean FROM target
UNION ALL SELECT 'after', count(*), round(median(los), 6), round(avg(los), 6) FROM kept""")
def outlier_report(spark, d):
    df = _target(spark, d)
    after = prepare.within_bounds(df, "los", *prepare.outlier_bounds(df, "los"))
    return rounded(prepare.before_after(df, after, "los"), 6, "median", "mean")


@query(f"""WITH {FENCE_SQL}
SELECT stay_id, round(ln(1 + least(los, 30)), 9) AS log_capped,
       round(exp(greatest(ln(1 + least(los, 30)) - 1, 0)) - 1, 9) AS back
FROM (SELECT * FROM target WHERE los IS NOT NULL)
UNION ALL SELECT stay_id, NULL, NULL FROM target WHERE los IS NULL""")
def log_target(spark, d):
    """Cap, log, and the way back with negative predictions at zero."""
    log = num.log_target(F.col("los"), 30)
    return _target(spark, d).select(
        "stay_id", F.round(log, 9).alias("log_capped"), F.round(num.from_log(log - 1), 9).alias("back"))


# --- growing category map --------------------------------------------------------------------

@query("""
SELECT o_custkey, o_orderkey, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def keep_last(spark, d):
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return profile.keep_last(orders, "o_custkey", "o_orderkey")


KNOWN_SQL = "known AS (SELECT DISTINCT trim(p_name) AS diagnosis FROM part WHERE p_type IN ('SMALL', 'PROMO') AND p_size < 5)"


def _known(spark, d):
    return load(spark, d, "part").filter("p_type IN ('SMALL', 'PROMO') AND p_size < 5").select(
        F.col("p_name").alias("diagnosis")).distinct()


@query(f"""WITH {KNOWN_SQL}
SELECT DISTINCT trim(p_name || ' ' || p_brand) AS diagnosis FROM part
WHERE trim(p_name || ' ' || p_brand) NOT IN (SELECT diagnosis || ' Brand#1' FROM known)""")
def incremental_anti(spark, d):
    """Texts the map does not hold yet."""
    texts = load(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("DIAGNOSIS"))
    known = _known(spark, d).select(F.concat("diagnosis", F.lit(" Brand#1")).alias("diagnosis"))
    return incremental.unclassified(texts, known)


@query("""
WITH t AS (SELECT count(DISTINCT trim(p_name || ' ' || p_brand)) AS n FROM part)
SELECT CAST(b AS BIGINT) AS batch, least(50, n - b * 50) AS n_texts FROM t, range(1000000) r(b) WHERE b * 50 < n""")
def batches_of_50(spark, d):
    texts = load(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("diagnosis"))
    batches = incremental.batched(profile.distinct_text(texts, "diagnosis"))
    return incremental.requests(batches).select("batch", F.size("texts").cast("long").alias("n_texts"))


@query("""
WITH a AS (SELECT trim(p_name) AS diagnosis, p_type AS category, p_partkey AS seq FROM part
           UNION ALL SELECT trim(p_name), p_brand, p_partkey + 1000000 FROM part WHERE p_size < 3)
SELECT diagnosis, arg_max(category, seq) AS category, max(seq) AS seq FROM a GROUP BY 1""")
def merged_category_map(spark, d):
    """Old and new answers, the last one per text."""
    part = load(spark, d, "part")
    old = part.select(F.trim("p_name").alias("diagnosis"), F.col("p_type").alias("category"), F.col("p_partkey").alias("seq"))
    new = part.filter("p_size < 3").select(
        F.trim("p_name").alias("diagnosis"), F.col("p_brand").alias("category"),
        (F.col("p_partkey") + 1_000_000).alias("seq"))
    return incremental.merged_map(old, new)


@query("SELECT p_name AS diagnosis, p_type AS category FROM part WHERE p_size >= 10")
def parsed_answers(spark, d):
    """JSON answers to rows; answers without the expected list give none."""
    answer = F.array(F.struct(F.col("p_name").alias("diagnosis"), F.col("p_type").alias("category")))
    response = F.when(F.col("p_size") >= 10, F.to_json(F.struct(answer.alias("results")))).otherwise(F.lit('{"other": 1}'))
    return incremental.parsed_answers(load(spark, d, "part").select(response.alias("response")))
