"""Windows, code maps, wide tables, joins and clinical extras."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import keyword_flags
from ...operators import clinical, codemap, features, profile, windows
from ...operators.codemap import normalised_dictionary
from ...operators.skew import left_join_many
from ...session import load
from ...sources.writers import timestamps_as_text
from .base import EVENT_FEATURES, EVENT_MAP, EVENTS_SQL, events, first_week, rounded

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def _columns(metric_sql: dict[str, str]) -> str:
    return ",\n".join(
        f"{expr.format(f=f)} AS {f}_{m}" for m, expr in metric_sql.items() for f in EVENT_FEATURES)


def _week(spark, d, value="value"):
    return windows.filter_by_window(events(spark, d), first_week(spark, d), "user_id", "ts", "s", "e", value)


def _numeric(spark, d, metrics):
    return features.numeric_feature_table(
        _week(spark, d), EVENT_MAP, "user_id", "code", "value", "ts", metrics)


@query(f"""
WITH {EVENTS_SQL}
SELECT user_id, {_columns({
    "min": "min(value) FILTER (WHERE feature = '{f}')",
    "avg": "round(avg(value) FILTER (WHERE feature = '{f}'), 9)",
    "max": "max(value) FILTER (WHERE feature = '{f}')"})}
FROM inside WHERE feature IS NOT NULL GROUP BY user_id""")
def wide_numeric_7d(spark, d):
    """Smallest, mean and largest value per feature over each user's first seven days."""
    return rounded(_numeric(spark, d, ("min", "avg", "max")), 9, *[f"{f}_avg" for f in EVENT_FEATURES])


@query(f"""
WITH {EVENTS_SQL}
SELECT user_id, {_columns({"latest": "arg_max(value, ts) FILTER (WHERE feature = '{f}')"})}
FROM inside WHERE feature IS NOT NULL GROUP BY user_id""")
def wide_latest(spark, d):
    return _numeric(spark, d, ("latest",))


@query(f"""
WITH {EVENTS_SQL}
SELECT user_id, {_columns({
    "sum": "round(sum(value) FILTER (WHERE feature = '{f}'), 4)",
    "count": "nullif(count(value) FILTER (WHERE feature = '{f}'), 0)"})}
FROM inside WHERE feature IS NOT NULL GROUP BY user_id""")
def wide_sum_count(spark, d):
    return rounded(_numeric(spark, d, ("sum", "count")), 4, *[f"{f}_sum" for f in EVENT_FEATURES])


@query(f"""
WITH {EVENTS_SQL}
SELECT user_id, {_columns({
    "num": "count(*) FILTER (WHERE feature = '{f}')",
    "had": "CAST(count(*) FILTER (WHERE feature = '{f}') > 0 AS INTEGER)"})}
FROM inside WHERE feature IS NOT NULL GROUP BY user_id""")
def occurrence_num_had(spark, d):
    return features.occurrence_feature_table(_week(spark, d), EVENT_MAP, "user_id", "code")


@query(f"""
WITH {EVENTS_SQL}
SELECT user_id, feature AS feature_name, min(value) AS min_value, round(avg(value), 9) AS avg_value,
       max(value) AS max_value, count(value) AS count_value, round(sum(value), 4) AS sum_value,
       arg_max(value, ts) AS latest_value
FROM named WHERE feature IS NOT NULL GROUP BY user_id, feature""")
def long_feature_aggregate(spark, d):
    """Every metric per user and feature over the whole history, before spreading."""
    named = codemap.add_feature_name(events(spark, d), codemap.code_map(spark, EVENT_MAP), "code")
    long = features.aggregate_features(
        named, "user_id", value_column="value", time_column="ts",
        metrics=("min", "avg", "max", "count", "sum", "latest"))
    return rounded(rounded(long, 9, "avg_value"), 4, "sum_value")


@query(f"WITH {EVENTS_SQL} SELECT event_id, user_id, code, value FROM inside")
def windowed_events(spark, d):
    """The pre-filtered event extract."""
    return _week(spark, d).select("event_id", "user_id", "code", "value")


@query(f"""WITH {EVENTS_SQL}
SELECT event_id, code FROM events_coded WHERE code BETWEEN 0 AND 94""")
def code_membership(spark, d):
    return codemap.filter_codes(events(spark, d), codemap.selected_codes(EVENT_MAP), "code").select("event_id", "code")


@query(f"""WITH {EVENTS_SQL}
SELECT coalesce(feature, 'none') AS feature, count(*) AS n FROM named GROUP BY 1""")
def mapped_codes(spark, d):
    """Literal map semantics: a code without feature gives NULL."""
    named = codemap.add_feature_name(events(spark, d), codemap.code_map(spark, EVENT_MAP), "code", "left")
    return named.groupBy(F.coalesce("feature_name", F.lit("none")).alias("feature")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT a.o_orderkey AS stay, count(*) AS n_inside, round(sum(b.o_totalprice), 4) AS total_inside,
       arg_max(b.o_totalprice, {'d': b.o_orderdate, 'p': b.o_totalprice}) AS latest_inside
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
WHERE b.o_orderdate >= a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 365 DAY
GROUP BY a.o_orderkey""")
def window_fanout(spark, d):
    """Many windows per person: an order counts in the year after each order of the same customer."""
    orders = load(spark, d, "orders")
    ref = orders.select(
        "o_custkey", F.col("o_orderkey").alias("stay"), F.col("o_orderdate").alias("s"),
        (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("e"))
    hits = windows.filter_by_windows(
        orders.select("o_custkey", "o_orderdate", "o_totalprice"), ref, "o_custkey", "o_orderdate", "s", "e",
        "o_totalprice", bucket_seconds=90 * 86_400)
    return hits.groupBy("stay").agg(
        F.count(F.lit(1)).alias("n_inside"), F.round(F.sum("o_totalprice"), 4).alias("total_inside"),
        F.max_by("o_totalprice", F.struct("o_orderdate", "o_totalprice")).alias("latest_inside"))


@query("""
SELECT c_custkey, o_orderkey, o_orderpriority, n_lines,
       strftime(o_orderdate + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end
FROM customer LEFT JOIN orders ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def base_left_chain(spark, d):
    """Person, admission, stay by left joins; timestamps written as text."""
    customers = load(spark, d, "customer").select("c_custkey")
    orders = load(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", "o_orderdate")
    lines = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"))
    base = features.left_join(left_join_many(customers, orders, ["c_custkey"]), lines, "o_orderkey")
    base = windows.add_window_end(base, "o_orderdate", 24, "window_end").drop("o_orderdate")
    return timestamps_as_text(base).select("c_custkey", "o_orderkey", "o_orderpriority", "n_lines", "window_end")


@query("""
SELECT user_id, clicks, errors, views FROM
  (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' AND hour(ts) = 3 GROUP BY 1)
  FULL JOIN (SELECT user_id, count(*) AS errors FROM events WHERE event_type = 'error' AND hour(ts) = 4 GROUP BY 1) USING (user_id)
  FULL JOIN (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' AND hour(ts) = 5 GROUP BY 1) USING (user_id)""")
def outer_feature_tables(spark, d):
    """Kinds of events in an hour of the night: each table has the users who have such events, some two fifths of all."""
    e = load(spark, d, "events")
    tables = [
        e.filter((F.col("event_type") == t) & (F.hour("ts") == h)).groupBy("user_id").agg(F.count(F.lit(1)).alias(n))
        for t, h, n in (("click", 3, "clicks"), ("error", 4, "errors"), ("view", 5, "views"))]
    return features.join_feature_tables(tables, "user_id")


@query(f"""
WITH {EVENTS_SQL},
num AS (SELECT user_id, max(value) FILTER (WHERE feature = 'pulse_rate') AS pulse_rate_max,
               max(value) FILTER (WHERE feature = 'pressure_arm') AS pressure_arm_max,
               max(value) FILTER (WHERE feature = 'lactate_blood') AS lactate_blood_max,
               max(value) FILTER (WHERE feature = 'glucose_bedside') AS glucose_bedside_max
        FROM inside WHERE feature IS NOT NULL GROUP BY 1),
occ AS (SELECT user_id, count(*) AS errors_num FROM inside WHERE event_type = 'error' AND code < 20 GROUP BY 1)
SELECT c_custkey AS user_id, c_mktsegment, pulse_rate_max, pressure_arm_max, lactate_blood_max,
       glucose_bedside_max, errors_num
FROM customer LEFT JOIN num ON c_custkey = num.user_id LEFT JOIN occ ON c_custkey = occ.user_id""")
def features_on_base(spark, d):
    """Feature tables attached to the base; a base row without events keeps NULLs."""
    base = load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    week = _week(spark, d)
    numeric = features.numeric_feature_table(week, EVENT_MAP, "user_id", "code", "value", "ts", ("max",))
    errors = features.occurrence_feature_table(
        week.filter("event_type = 'error'"), {"errors": list(range(20))}, "user_id", "code").drop("errors_had")
    return features.attach_feature_tables(base, [numeric, errors], "user_id")


# --- code dictionary ------------------------------------------------------------------------

SEARCH = {
    "widget": ["widget"],
    "bolt_or_gear": ["BOLT", "gear$"],
    "small": ["^small "],
    "optional": ["ring (s)?$", "cold (g)"],
    "never": ["no such part"],
}
MAP_SQL = """
map AS (
  SELECT p_partkey AS code, feature_name, map_order FROM part,
    (VALUES (0, 'widget', 'widget'), (1, 'bolt_or_gear', '(bolt)|(gear$)'), (2, 'small', '^small '),
            (3, 'optional', '(ring (s)?$)|(cold (g))'), (4, 'never', 'no such part'))
    AS s(map_order, feature_name, pattern)
  WHERE regexp_matches(lower(p_name), pattern))
"""


def _dictionary(spark, d):
    part = load(spark, d, "part").select(
        F.col("p_partkey").alias("itemid"), F.upper("p_name").alias("label"), F.col("p_type").alias("category"))
    return normalised_dictionary(part, ["LABEL", "CATEGORY", "DBSOURCE"])


def _map(spark, d):
    return codemap.keyword_map(_dictionary(spark, d), SEARCH)


@query(f"""
WITH {MAP_SQL}
SELECT s.feature_name, count(m.code) AS n_codes, coalesce(sum(m.code), 0)::BIGINT AS code_sum,
       min(m.code) AS first_code, max(m.code) AS last_code
FROM (VALUES ('widget'), ('bolt_or_gear'), ('small'), ('optional'), ('never')) AS s(feature_name)
LEFT JOIN map m USING (feature_name) GROUP BY 1""")
def code_map_keywords(spark, d):
    """Codes per searched feature: number, sum and ends."""
    return codemap.code_counts(_map(spark, d), SEARCH)


@query(f"""
WITH {MAP_SQL}
SELECT DISTINCT CAST(map_order AS INTEGER) AS map_order, feature_name, code FROM map""")
def code_map_rows(spark, d):
    """The map as a table of (feature, code) rows."""
    return codemap.feature_codes(_map(spark, d))


@query(f"""
WITH {MAP_SQL}
SELECT code, count(DISTINCT feature_name) AS n_features, arg_max(feature_name, map_order) AS kept_by
FROM map GROUP BY code HAVING count(DISTINCT feature_name) > 1""")
def code_map_collisions(spark, d):
    return codemap.collisions(_map(spark, d))


@query(f"""
WITH {MAP_SQL}
SELECT code, arg_max(feature_name, map_order) AS feature_name, CAST(max(map_order) AS INTEGER) AS map_order
FROM map GROUP BY code""")
def code_map_last_wins(spark, d):
    return codemap.last_wins(_map(spark, d))


@query(f"""
WITH {MAP_SQL}
SELECT count(*) FILTER (WHERE n > 0) AS n_found, count(*) AS n_features
FROM (SELECT s.feature_name, count(m.code) AS n
      FROM (VALUES ('widget'), ('bolt_or_gear'), ('small'), ('optional'), ('never')) AS s(feature_name)
      LEFT JOIN map m USING (feature_name) GROUP BY 1)""")
def code_map_coverage(spark, d):
    return codemap.coverage(codemap.code_counts(_map(spark, d), SEARCH))


@query(f"""
WITH {MAP_SQL}
SELECT p_partkey AS itemid, lower(p_name) AS label FROM part WHERE p_partkey IN (SELECT code FROM map)""")
def code_map_labels(spark, d):
    return codemap.labels_of(_dictionary(spark, d), _map(spark, d)).select(
        F.col("ITEMID").alias("itemid"), F.col("LABEL").alias("label"))


@query("SELECT lower(p_type) AS category, count(*) AS n_items FROM part GROUP BY 1")
def dictionary_categories(spark, d):
    return codemap.category_counts(_dictionary(spark, d)).withColumnRenamed("CATEGORY", "category")


# --- clinical extras ------------------------------------------------------------------------

@query("""
WITH marked AS (
  SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 24 HOUR
                           THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked)
SELECT user_id, CAST(session AS BIGINT) AS session, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n_rows
FROM numbered GROUP BY 1, 2""")
def sessions_24h(spark, d):
    """Events less than 24 hours apart are one stay."""
    return timestamps_as_text(clinical.merge_stays(load(spark, d, "events"), "user_id", "ts"))


@query("""
WITH i AS (SELECT user_id, sum(value) AS input_total FROM events WHERE event_type = 'click' GROUP BY 1),
o AS (SELECT user_id, sum(value) AS output_total, sum(value) FILTER (WHERE value > 50) AS urine_total
      FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, round(coalesce(input_total, 0), 4) AS input_total, round(coalesce(output_total, 0), 4) AS output_total,
       round(coalesce(input_total, 0) - coalesce(output_total, 0), 4) AS fluid_balance,
       round(coalesce(urine_total, 0) / 24, 9) AS urine_per_hour
FROM i FULL JOIN o USING (user_id)""")
def fluid_balance(spark, d):
    e = load(spark, d, "events")
    table = clinical.fluid_balance(
        e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), "user_id", "value", "value",
        F.col("value") > 50)
    return rounded(rounded(table, 4, "input_total", "output_total", "fluid_balance"), 9, "urine_per_hour")


@query("""
SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1""")
def distinct_roles(spark, d):
    """Different helpers per stay."""
    return clinical.distinct_per_key(load(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "n_suppliers")


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n_abnormal, max(value) AS max_value,
       round(regr_slope(value, epoch(ts) / 3600.0 - 473352.0), 6) AS trend_per_hour
FROM events GROUP BY 1""")
def lab_course(spark, d):
    """Abnormal results, largest value and slope per hour of each user."""
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600.0 - 473352.0
    flag = F.when(F.col("event_type") == "error", F.lit("ABNORMAL"))
    e = load(spark, d, "events").select("user_id", "value", hours.alias("hours"), flag.alias("flag"))
    return rounded(clinical.lab_course(e, "user_id", "value", "hours", "flag"), 6, "trend_per_hour")


@query("""
WITH rx AS (SELECT o_custkey, least(o_orderdate, l_shipdate) AS s, greatest(o_orderdate, l_shipdate) AS e
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o.o_orderkey AS stay, count(rx.s) AS n_active
FROM orders o LEFT JOIN rx ON o.o_custkey = rx.o_custkey AND o.o_orderdate BETWEEN rx.s AND rx.e
GROUP BY 1""")
def active_at_start(spark, d):
    """Lines of the same customer that are open on the day of each order."""
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    lines = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    rx = orders.join(lines, "o_orderkey").select("o_custkey", F.least("o_orderdate", "l_shipdate").alias("STARTDATE"),
             F.greatest("o_orderdate", "l_shipdate").alias("ENDDATE"))
    stays = orders.withColumnsRenamed({"o_orderkey": "stay", "o_orderdate": "at"})
    return clinical.active_at(stays, rx, "o_custkey", "stay", "at")


@query("""
SELECT o_custkey, arg_min(o_orderpriority, {'d': o_orderdate, 'p': o_orderpriority}) AS primary_service,
       CAST(arg_min(o_orderpriority, {'d': o_orderdate, 'p': o_orderpriority}) IN ('1-URGENT', '2-HIGH') AS INTEGER) AS surgical
FROM orders GROUP BY 1""")
def primary_service(spark, d):
    return clinical.primary_service(
        load(spark, d, "orders"), ["1-URGENT", "2-HIGH"], "o_custkey", "o_orderdate", "o_orderpriority")


@query("""
SELECT o_custkey,
       CAST(max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 200000 THEN 1 ELSE 0 END) AS INTEGER) AS urgent_done,
       CAST(max(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AND o_totalprice <= 200000 THEN 1 ELSE 0 END) AS INTEGER) AS low_open
FROM orders GROUP BY 1""")
def marker_flags(spark, d):
    """Organism, antibiotic and result are played by status, priority and price."""
    micro = load(spark, d, "orders").select(
        "o_custkey", F.col("o_orderstatus").alias("ORG_NAME"), F.col("o_orderpriority").alias("AB_NAME"),
        F.when(F.col("o_totalprice") > 200_000, F.lit("R")).otherwise(F.lit("S")).alias("INTERPRETATION"))
    return clinical.resistance_flags(
        micro, "o_custkey", {"urgent_done": ("F", "1-URGENT", "R"), "low_open": ("P", "5-LOW", "S")})


@query("""
SELECT l_orderkey AS stay, count(*) AS n_procedures, round(sum(
         date_diff('second', greatest(o_orderdate, l_shipdate - INTERVAL 10 DAY),
                   least(o_orderdate + INTERVAL 365 DAY, l_shipdate))) / 3600.0, 4) AS procedure_hours
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate - INTERVAL 10 DAY <= o_orderdate + INTERVAL 365 DAY AND l_shipdate >= o_orderdate
GROUP BY 1""")
def procedure_hours(spark, d):
    """Ten days before each shipment, as far as they lie in the year after the order."""
    lines = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("stay"), (F.col("l_shipdate") - F.expr("INTERVAL 10 DAYS")).alias("STARTTIME"),
        F.col("l_shipdate").alias("ENDTIME"))
    ref = windows.add_window_end(
        load(spark, d, "orders").select(F.col("o_orderkey").alias("stay"), F.col("o_orderdate").alias("INTIME")),
        "INTIME", 365 * 24)
    return rounded(clinical.procedure_features(lines, ref, "stay"), 4, "procedure_hours")


@query("""
SELECT doc_id, CAST(regexp_matches(text, 'licen[sc]e', 'i') AS INTEGER) AS license,
       CAST(regexp_matches(text, '[a-z0-9]@[a-z]', 'i') AS INTEGER) AS mail
FROM documents""")
def note_keywords(spark, d):
    """Keyword flags over whole texts."""
    return keyword_flags(load(spark, d, "documents"), "text", {"license": "licen[sc]e", "mail": "[a-z0-9]@[a-z]"}
                         ).select("doc_id", "license", "mail")


@query("""
SELECT o_custkey, o_orderkey, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
WHERE r = 1""")
def first_per_key(spark, d):
    """One row per key with a fixed survivor."""
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return profile.first_per_key(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")
