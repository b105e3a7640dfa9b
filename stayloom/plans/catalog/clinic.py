"""Clinical extras on stand-ins that vary every condition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import clinical
from ...session import load

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn
    return register


def _micro(spark, d):
    return load(spark, d, "orders").select(
        F.col("o_custkey").alias("HADM_ID"), F.col("o_orderpriority").alias("SPEC_TYPE_DESC"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("ORG_NAME"))


@query("""
SELECT o_custkey AS "HADM_ID", count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_specimens,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS n_organisms
FROM orders GROUP BY 1""")
def culture_counts(spark, d):
    return clinical.culture_counts(_micro(spark, d), specimens=["1-URGENT", "2-HIGH"], organisms=["F"])


@query("""
SELECT l_orderkey AS "HADM_ID", CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS confirmed_infection
FROM lineitem GROUP BY 1""")
def confirmed_infection(spark, d):
    micro = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("HADM_ID"), F.when(F.col("l_returnflag") == "R", F.lit("grown")).alias("ORG_NAME"))
    return clinical.confirmed_infection(micro)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_orderkey % 3 = 1 AND (l_returnflag = 'N' OR l_shipdate >= o_orderdate)""")
def charted_forward_stays(spark, d):
    """Charted admissions, and of their stays those that do not end before they start (an open end stays)."""
    admissions = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("INTIME"),
        F.when(F.col("o_orderkey") % 3 == 1, 1).otherwise(0).alias("HAS_CHARTEVENTS_DATA"))
    stays = load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("OUTTIME"))
    joined = clinical.charted_admissions(admissions).join(stays, "l_orderkey")
    return clinical.forward_stays(joined).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, (epoch(l_shipdate) - epoch(o_orderdate)) / 3600 AS ready_delay_hours
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def outcome_delay(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("CREATETIME"))
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("OUTCOMETIME"))
    return clinical.outcome_delay(lines.join(orders, "l_orderkey")).drop("CREATETIME", "OUTCOMETIME")


@query("""
SELECT l_orderkey AS "ICUSTAY_ID", count(DISTINCT s_nationkey) AS n_roles
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def caregiver_diversity(spark, d):
    given = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("ICUSTAY_ID"), F.col("l_suppkey").alias("CGID"))
    people = load(spark, d, "supplier").select(F.col("s_suppkey").alias("CGID"), F.col("s_nationkey").cast("string").alias("LABEL"))
    return clinical.caregiver_diversity(given, people)


@query("""SELECT l_orderkey AS "HADM_ID", l_partkey AS "ICD9_CODE" FROM lineitem WHERE l_linenumber = 1""")
def primary_diagnosis(spark, d):
    return clinical.primary_diagnosis(_diagnoses(spark, d)).drop("SEQ_NUM")


@query("""
SELECT DISTINCT l_orderkey AS "HADM_ID" FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE regexp_matches(p_name, 'cold w|SMALL', 'i')""")
def diagnosis_cohort(spark, d):
    titles = load(spark, d, "part").select(F.col("p_partkey").alias("ICD9_CODE"), F.col("p_name").alias("LONG_TITLE"))
    return clinical.diagnosis_cohort(_diagnoses(spark, d), titles, "cold w|SMALL")


def _diagnoses(spark, d):
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("HADM_ID"), F.col("l_linenumber").alias("SEQ_NUM"), F.col("l_partkey").alias("ICD9_CODE"))
