"""Clinical features described beside the main build: infections, fluids, procedures, services."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import ORGANISMS_OF_INTEREST, RESISTANCE_MARKERS, SPECIMEN_TYPES
from ..functions.numbers import hours_between
from .profile import first_per_key
from .ranks import present
from .skew import lookup_join


def resistance_flags(micro: DataFrame, key: str = "HADM_ID",
                     markers: Mapping[str, tuple[str, str, str]] = RESISTANCE_MARKERS) -> DataFrame:
    """0/1 per admission and marker: organism tested against an antibiotic with the given result."""
    return micro.filter(F.col(key).isNotNull()).groupBy(key).agg(*[
        F.max(F.coalesce(
            (F.col("ORG_NAME") == organism) & (F.col("AB_NAME") == antibiotic)
            & (F.col("INTERPRETATION") == result), F.lit(False)).cast("int")).alias(name)
        for name, (organism, antibiotic, result) in markers.items()])


def confirmed_infection(micro: DataFrame, key: str = "HADM_ID") -> DataFrame:
    """1 where any culture of the admission grew an organism."""
    return micro.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(F.col("ORG_NAME").isNotNull().cast("int")).alias("confirmed_infection"))


def culture_counts(micro: DataFrame, key: str = "HADM_ID", specimens: Sequence[str] = SPECIMEN_TYPES,
                   organisms: Sequence[str] = ORGANISMS_OF_INTEREST) -> DataFrame:
    """Cultures of the listed specimen types and growths of the listed organisms per admission."""
    return micro.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_if(F.col("SPEC_TYPE_DESC").isin(list(specimens))).alias("n_specimens"),
        F.count_if(F.col("ORG_NAME").isin(list(organisms))).alias("n_organisms"))


def charted_admissions(admissions: DataFrame) -> DataFrame:
    return admissions.filter(F.col("HAS_CHARTEVENTS_DATA") == 1)


def forward_stays(stays: DataFrame, start: str = "INTIME", end: str = "OUTTIME") -> DataFrame:
    """Stays that do not end before they start."""
    return stays.filter(F.col(end).isNull() | (F.col(end) >= F.col(start)))


def merge_stays(moves: DataFrame, key: str, start: str, end: str | None = None, gap_hours: int = 24) -> DataFrame:
    """``(key, session, started, ended, n_rows)``: moves less than the gap apart are one stay.

    Two moves that start in one bucket as long as the gap always belong together, so moves merge
    per (key, bucket) before the shuffle and the ordered pass sees buckets only.
    """
    gap = gap_hours * 3600 * 1_000_000
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    s = F.col(start)
    e = F.greatest(s, F.coalesce(F.col(end), s)) if end else s
    buckets = (
        moves.filter(F.col(key).isNotNull() & s.isNotNull())
        .groupBy(key, F.floor(micros(s) / F.lit(gap)).alias("__b"))
        .agg(F.min(s).alias("s"), F.max(e).alias("e"), F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy(key).orderBy("__b")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(micros(F.col("s")) - micros(reached) >= F.lit(gap), F.lit(True)).cast("int")
    return (
        buckets.withColumn("__new", fresh)
        .withColumn("session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(key, "session")
        .agg(F.min("s").alias("started"), F.max("e").alias("ended"), F.sum("n").alias("n_rows"))
    )


def outcome_delay(callout: DataFrame) -> DataFrame:
    """Hours between the request to leave and its outcome."""
    return callout.withColumn(
        "ready_delay_hours", hours_between(F.col("OUTCOMETIME"), F.col("CREATETIME")))


def procedure_features(procedures: DataFrame, reference: DataFrame, key: str = "ICUSTAY_ID",
                       start: str = "STARTTIME", end: str = "ENDTIME", window_start: str = "INTIME",
                       window_end: str = "END_FIRST_24H") -> DataFrame:
    """Per stay: procedures that touch the window and their hours inside it."""
    ref = reference.select(key, F.col(window_start).alias("__ws"), F.col(window_end).alias("__we"))
    rows = lookup_join(procedures.filter(F.col(key).isNotNull()), ref, [key])
    inside = hours_between(F.least(F.col(end), F.col("__we")), F.greatest(F.col(start), F.col("__ws")))
    return (
        rows.filter((F.col(start) <= F.col("__we")) & (F.col(end) >= F.col("__ws")))
        .groupBy(key).agg(F.count(F.lit(1)).alias("n_procedures"), F.sum(inside).alias("procedure_hours"))
    )


def fluid_balance(inputs: DataFrame, outputs: DataFrame, key: str = "ICUSTAY_ID", amount: str = "AMOUNT",
                  value: str = "VALUE", urine=None, hours: float = 24.0) -> DataFrame:
    """Per stay: inputs, outputs, balance and urine per hour. ``urine`` is a condition on the outputs."""
    urine = F.lit(True) if urine is None else urine
    a = inputs.groupBy(key).agg(F.sum(amount).alias("input_total"))
    b = outputs.groupBy(key).agg(
        F.sum(value).alias("output_total"), F.sum(F.when(urine, F.col(value))).alias("urine_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return a.join(b, key, "outer").select(
        key, zero("input_total").alias("input_total"), zero("output_total").alias("output_total"),
        (zero("input_total") - zero("output_total")).alias("fluid_balance"),
        (zero("urine_total") / F.lit(float(hours))).alias("urine_per_hour"))


def distinct_per_key(df: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """Number of distinct values per key; pairs are made distinct first, so no group holds its rows."""
    pairs = df.filter(F.col(key).isNotNull() & F.col(column).isNotNull()).select(key, column).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def caregiver_diversity(events: DataFrame, caregivers: DataFrame, key: str = "ICUSTAY_ID") -> DataFrame:
    roles = caregivers.select("CGID", F.col("LABEL").alias("__role"))
    pairs = events.filter(F.col(key).isNotNull()).select(key, "CGID").distinct()
    return distinct_per_key(lookup_join(pairs, roles, ["CGID"]), key, "__role", "n_roles")


def lab_course(labs: DataFrame, key: str, value: str = "VALUENUM", hours: str = "hours",
               flag: str = "FLAG") -> DataFrame:
    """Per key: abnormal results, largest value and slope per hour."""
    ok = present(F.col(value))
    v = F.when(ok, F.col(value))
    return labs.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_if(F.lower(F.col(flag)) == "abnormal").alias("n_abnormal"),
        F.max(v).alias("max_value"), F.regr_slope(v, F.col(hours)).alias("trend_per_hour"))


def active_at(stays: DataFrame, prescriptions: DataFrame, key: str = "HADM_ID", stay: str = "ICUSTAY_ID",
              at: str = "INTIME", start: str = "STARTDATE", end: str = "ENDDATE") -> DataFrame:
    """``(stay, n_active)``: prescriptions running at the start of each stay, one row per row of ``stays``.

    The number is the starts up to then less the ends before then. Both are summed per key and moment, moments
    are ordered within days, and days are summed before: no prescription is paired with a stay. Prescriptions
    that end before they start or lack a key or time count nowhere; stays without key or time have 0.
    """
    open_ones = prescriptions.select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e")).dropna().filter("s <= e")
    change = lambda time, kind, by: open_ones.groupBy("k", F.col(time).alias("t")).agg(
        (F.count(F.lit(1)) * by).alias("change")).withColumn("kind", F.lit(kind))
    asked = stays.select(F.col(key).alias("k"), F.col(at).alias("t"), F.col(stay).alias("stay"))
    moments = (
        # At one moment starts come before the question and ends after it.
        change("s", 0, 1).unionByName(change("e", 2, -1)).withColumn("stay", F.lit(None).cast(asked.schema["stay"].dataType))
        .unionByName(asked.dropna(subset=["k", "t"]).withColumn("change", F.lit(0).cast("long")).withColumn("kind", F.lit(1)))
        .withColumn("day", F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / 86_400))
    )
    within = Window.partitionBy("k", "day").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = moments.groupBy("k", "day").agg(F.sum("change").alias("change")).select(
        "k", "day", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("earlier"))
    counted = (
        moments.withColumn("today", F.sum("change").over(within)).filter("kind = 1").join(days, ["k", "day"])
        .select(F.col("stay").alias(stay), (F.col("earlier") + F.col("today")).alias("n_active")))
    none = asked.filter(F.col("k").isNull() | F.col("t").isNull()).select(
        F.col("stay").alias(stay), F.lit(0).cast("long").alias("n_active"))
    return counted.unionByName(none)


def primary_diagnosis(diagnoses: DataFrame) -> DataFrame:
    return diagnoses.filter(F.col("SEQ_NUM") == 1)


def diagnosis_cohort(diagnoses: DataFrame, titles: DataFrame, pattern: str, code: str = "ICD9_CODE",
                     title: str = "LONG_TITLE", key: str = "HADM_ID") -> DataFrame:
    """Admissions with a diagnosis whose title matches the pattern."""
    wanted = titles.filter(F.col(title).rlike(f"(?i){pattern}")).select(code).distinct()
    return lookup_join(diagnoses, wanted, [code], "left_semi").select(key).distinct()


def primary_service(services: DataFrame, surgical: Sequence[str], key: str = "HADM_ID",
                    time: str = "TRANSFERTIME", service: str = "CURR_SERVICE") -> DataFrame:
    """First service of each admission and whether it is a surgical one."""
    first = first_per_key(services.filter(F.col(key).isNotNull()).select(key, time, service), key, [time])
    return first.select(key, F.col(service).alias("primary_service"),
                        F.col(service).isin(list(surgical)).cast("int").alias("surgical"))

