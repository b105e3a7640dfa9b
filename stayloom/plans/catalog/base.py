"""Stand-ins: which star-schema table plays which clinical one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...session import load

# Codes 20 to 24 are claimed twice: the later feature keeps them. 95 to 99 belong to no feature.
EVENT_MAP = {
    "Pulse Rate": list(range(0, 25)),
    "pressures": {"Pressure (arm)": list(range(20, 50))},
    "labs": {"Lactate/blood": list(range(50, 80)), "Glucose-bedside": list(range(80, 95))},
}
EVENT_FEATURES = ["pulse_rate", "pressure_arm", "lactate_blood", "glucose_bedside"]

EVENTS_SQL = """
events_coded AS (
  SELECT event_id, user_id, ts, event_type, value,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS code
  FROM events),
named AS (
  SELECT *, CASE WHEN code < 20 THEN 'pulse_rate' WHEN code < 50 THEN 'pressure_arm'
                 WHEN code < 80 THEN 'lactate_blood' WHEN code < 95 THEN 'glucose_bedside' END AS feature
  FROM events_coded),
ref AS (
  SELECT user_id, min(ts) AS s, min(ts) + INTERVAL 7 DAY AS e FROM events GROUP BY user_id),
inside AS (
  SELECT n.* FROM named n JOIN ref r ON n.user_id = r.user_id
  WHERE n.ts >= r.s AND n.ts <= r.e)
"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """Long event table: id, time, code, value."""
    code = F.get_json_object("props", "$.k").try_cast("bigint")
    return load(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value", code.alias("code"))


def first_week(spark: SparkSession, d: str) -> DataFrame:
    """Window of each user: seven days from the first event."""
    return (
        load(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("s"))
        .withColumn("e", F.col("s") + F.expr("INTERVAL 7 DAYS"))
    )


STAY_SQL = """
per_order AS (
  SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty, avg(l_quantity) AS avg_qty,
         round(avg(l_extendedprice) / 1000, 9) AS avg_price, round(avg(l_discount) * 100, 9) AS avg_discount,
         round(sum(l_extendedprice) / 20000, 9) AS los
  FROM lineitem GROUP BY l_orderkey),
stays AS (
  SELECT o_custkey AS subject_id, o_orderkey AS stay_id, o_orderpriority AS admission_type,
         o_orderstatus AS gender, n_lines, sum_qty, avg_qty, avg_price, avg_discount, los
  FROM orders JOIN per_order ON o_orderkey = l_orderkey)
"""


def stays(spark: SparkSession, d: str) -> DataFrame:
    """One row per order with lines: person, stay, categories, numbers, and a length in days.

    Sums of decimals are rounded, so that equal values are equal whatever the order of adding.
    """
    per_order = load(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty"),
        F.avg("l_quantity").alias("avg_qty"), F.round(F.avg("l_extendedprice") / 1000, 9).alias("avg_price"),
        F.round(F.avg("l_discount") * 100, 9).alias("avg_discount"),
        F.round(F.sum("l_extendedprice") / 20000, 9).alias("los"))
    orders = load(spark, d, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("stay_id"),
        F.col("o_orderpriority").alias("admission_type"), F.col("o_orderstatus").alias("gender"))
    return orders.join(per_order, F.col("stay_id") == F.col("l_orderkey")).drop("l_orderkey")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
