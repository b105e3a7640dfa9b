"""Dose roll-ups and top items. Customer, order and order line play person, admission and stay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import rollup, timeline
from ...operators.ranks import group_sizes
from ...session import load, measured, row_count, widened
from .base import events, rounded

QUERIES: dict = {}
ORACLES: dict = {}
C = rollup.DoseColumns("subject", "admission", "stay", "item", "label", "amount")


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


DOSE_SQL = """
doses AS (
  SELECT o_custkey AS subject, l_orderkey AS admission, l_orderkey * 10 + l_linenumber AS stay,
         l_partkey AS item, p_name AS label, l_quantity AS amount, l_shipdate, o_orderdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey),
stays AS (
  SELECT stay, (epoch(max(greatest(l_shipdate, o_orderdate))) - epoch(min(o_orderdate))) / 3600.0 AS LOS_hours
  FROM doses GROUP BY stay),
lvl1 AS (
  SELECT subject, admission, stay, item, label, sum(amount) AS Total_Amount, avg(amount) AS Mean_Dose,
         median(amount) AS Median_Dose, stddev_samp(amount) AS Std_Dose, min(amount) AS Min_Dose,
         max(amount) AS Max_Dose, count(amount) AS Event_Count, max(LOS_hours) AS LOS_hours
  FROM doses JOIN stays USING (stay) WHERE label IS NOT NULL GROUP BY ALL),
lvl2 AS (
  SELECT subject, admission, item, label, sum(Total_Amount) AS Total_Amount_Admission,
         avg(Total_Amount) AS Mean_Per_Stay, stddev_samp(Total_Amount) AS Std_Per_Stay,
         CAST(sum(Event_Count) AS BIGINT) AS Total_Events_Admission, count(DISTINCT stay) AS N_ICU_Stays
  FROM lvl1 GROUP BY ALL),
lvl3 AS (
  SELECT subject, item, label, sum(Total_Amount_Admission) AS Total_Amount_All,
         avg(Total_Amount_Admission) AS Mean_Per_Admission, stddev_samp(Total_Amount_Admission) AS Std_Per_Admission,
         CAST(sum(Total_Events_Admission) AS BIGINT) AS Total_Events_All, count(DISTINCT admission) AS N_Admissions,
         CAST(sum(N_ICU_Stays) AS BIGINT) AS N_ICU_Stays_All
  FROM lvl2 GROUP BY ALL)
"""


def _doses(spark, d):
    """Stored dose rows, the same with their lookups, and their number."""
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    # The clinical tables are stored; here the dose rows are stored once, as stays and doses both read them.
    with widened(spark, row_count(lines)):
        inputs, size, _ = measured(lines.join(orders, "l_orderkey").select(
            F.col("o_custkey").alias("subject"), F.col("l_orderkey").alias("admission"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stay"),
            F.col("l_partkey").alias("item"), F.col("l_quantity").alias("amount"), "o_orderdate", "l_shipdate"), "doses")
    stays = inputs.groupBy("stay").agg(
        F.min("o_orderdate").alias("INTIME"), F.max(F.greatest("l_shipdate", "o_orderdate")).alias("OUTTIME"))
    items = load(spark, d, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("label"), F.col("p_type").alias("CATEGORY"))
    return inputs, rollup.dose_events(inputs.drop("o_orderdate", "l_shipdate"), items, stays, C, rows=size.rows), size.rows


def _stay(spark, d):
    """Level 1, and the number of dose rows, which no level exceeds."""
    inputs, doses, rows = _doses(spark, d)
    with widened(spark, rows):
        sizes = group_sizes(inputs, [C.stay, C.item])
    return rollup.dose_stats_stay(doses, C, sizes), rows


@query(f"""
WITH {DOSE_SQL}
SELECT subject, admission, stay, item, label, Total_Amount, round(Mean_Dose, 6) AS Mean_Dose, Median_Dose,
       round(Std_Dose, 6) AS Std_Dose, Min_Dose, Max_Dose, Event_Count, LOS_hours,
       round(Total_Amount / nullif(LOS_hours, 0), 9) AS Amount_per_LOS_hour FROM lvl1""")
def dose_stats_line(spark, d):
    return rounded(rounded(_stay(spark, d)[0], 6, "Mean_Dose", "Std_Dose"), 9, "Amount_per_LOS_hour")


@query(f"""
WITH {DOSE_SQL}
SELECT * REPLACE (round(Mean_Per_Stay, 6) AS Mean_Per_Stay, round(Std_Per_Stay, 6) AS Std_Per_Stay) FROM lvl2""")
def dose_stats_order(spark, d):
    stay, rows = _stay(spark, d)
    return rounded(rollup.dose_stats_admission(stay, C, rows), 6, "Mean_Per_Stay", "Std_Per_Stay")


def _person(spark, d):
    stay, rows = _stay(spark, d)
    return rollup.dose_stats_person(rollup.dose_stats_admission(stay, C, rows), C, rows)


@query(f"""
WITH {DOSE_SQL}
SELECT * REPLACE (round(Mean_Per_Admission, 6) AS Mean_Per_Admission,
                  round(Std_Per_Admission, 6) AS Std_Per_Admission) FROM lvl3""")
def dose_stats_customer(spark, d):
    return rounded(_person(spark, d), 6, "Mean_Per_Admission", "Std_Per_Admission")


@query(f"""
WITH {DOSE_SQL}
SELECT subject, item, Total_Amount_All, item_rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY subject ORDER BY Total_Amount_All DESC, item) AS INTEGER) AS item_rank
  FROM lvl3) WHERE item_rank <= 5""")
def topk_items(spark, d):
    """Five largest items of every person."""
    top = rollup.top_items(_person(spark, d), 5, subject="subject", ties=["item"])
    return top.select("subject", "item", "Total_Amount_All", "item_rank")


@query(f"""
WITH {DOSE_SQL}
SELECT item, label, Total_Amount_All, Total_Events_All FROM lvl3 WHERE subject = 23
ORDER BY Total_Amount_All DESC, item LIMIT 5""")
def topk_items_of_person(spark, d):
    return rollup.top_items_of(_person(spark, d), 23, 5, subject="subject", ties=["item"]).select(
        "item", "label", "Total_Amount_All", "Total_Events_All")


@query(f"""
WITH {DOSE_SQL}
SELECT subject, count(DISTINCT admission) AS N_Admissions, count(DISTINCT stay) AS N_ICU_Stays_All
FROM doses GROUP BY subject""")
def person_totals(spark, d):
    return rollup.person_totals(_doses(spark, d)[1], C)


# --- timeline of a stay: users play stays, 30 days play the day ------------------------------

SPAN_DAYS = 30.0


def _timeline(spark, d):
    rows = events(spark, d)
    stays = load(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("start"))
    return timeline.relative_events(rows, stays, "user_id", "ts", "start", span_days=SPAN_DAYS)


def _micros():
    return F.round(F.col("Relative_Day") * 86_400_000_000).cast("long").alias("relative_micros")


@query("""
WITH ref AS (SELECT user_id, min(ts) AS s FROM events GROUP BY 1)
SELECT event_id, epoch_us(ts) - epoch_us(s) AS relative_micros, value
FROM events JOIN ref USING (user_id) WHERE ts <= s + INTERVAL 30 DAY""")
def relative_time(spark, d):
    return _timeline(spark, d).select("event_id", _micros(), "value")


@query("""
WITH ref AS (SELECT user_id, min(ts) AS s FROM events WHERE user_id = 7 GROUP BY 1)
SELECT event_id, epoch_us(ts) - epoch_us(s) - 172800000000 AS relative_micros, value
FROM events JOIN ref USING (user_id) WHERE ts BETWEEN s + INTERVAL 2 DAY AND s + INTERVAL 3 DAY""")
def one_stay_third_day(spark, d):
    rows = events(spark, d)
    stays = load(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("start"))
    day = timeline.relative_events(rows, stays, "user_id", "ts", "start", day=3)
    return timeline.one_stay(day, 7, stay="user_id").select(
        "event_id", _micros(), "value")


# The k nearest rows of each point by distance; rows at the far end have weight zero, so ties do not matter.
@query("""
WITH ref AS (SELECT user_id, min(ts) AS s FROM events GROUP BY 1),
r AS (SELECT user_id, CAST(round(((epoch_us(ts) - epoch_us(s)) / 1e6 / 86400) * 86400.0) AS BIGINT) AS step, value,
             count(*) OVER (PARTITION BY user_id) AS n
      FROM events JOIN ref USING (user_id) WHERE ts <= s + INTERVAL 30 DAY AND value > 0),
p AS (SELECT user_id, step, n, avg(value) AS own FROM r GROUP BY ALL),
d AS (SELECT p.user_id, p.step, p.n, r.step - p.step AS gap, r.value AS v,
             row_number() OVER (PARTITION BY p.user_id, p.step ORDER BY abs(r.step - p.step)) AS i
      FROM p JOIN r ON p.user_id = r.user_id),
near AS (SELECT *, max(abs(gap)) OVER (PARTITION BY user_id, step) AS h FROM d WHERE i <= floor(0.35 * n + 1e-10)),
w AS (SELECT *, (1 - (abs(gap) / h) ^ 3) ^ 3 AS w FROM near WHERE h > 0),
m AS (SELECT user_id, step, max(h)::DOUBLE AS h, sum(w) AS t, sum(w * gap) AS m1, sum(w * gap * gap) AS m2,
             sum(w * v) AS q, sum(w * gap * v) AS qx
      FROM w GROUP BY ALL)
SELECT user_id, round(step / 86400.0, 9) AS x, round(CASE
         WHEN floor(0.35 * n + 1e-10) < 2 OR t IS NULL OR t <= 0 THEN own
         WHEN m2 - m1 * m1 / t > 1e-12 * t * h * h THEN q / t - (qx - m1 * q / t) / (m2 - m1 * m1 / t) * m1 / t
         ELSE q / t END, 6) AS trend
FROM p LEFT JOIN m USING (user_id, step)""")
def timeline_smooth(spark, d):
    """Local-linear trend of every user's values."""
    table = timeline.trend(_timeline(spark, d), "user_id", "value")
    return rounded(rounded(table, 9, "x"), 6, "trend")


@query()
def bootstrap_band(spark, d):
    """5 and 95 percent band of the trend from 200 resamples."""
    return timeline.bootstrap_band(_timeline(spark, d), "user_id", "value")
