"""Dose statistics at three levels: stay x item, admission x item, person x item."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import hours_between, ratio
from ..session import by_rows, measured, widened
from .ranks import BUILTIN_GROUP_ROWS, group_sizes, grouped_quantiles
from .skew import lookup_join


@dataclass(frozen=True)
class DoseColumns:
    subject: str = "SUBJECT_ID"
    admission: str = "HADM_ID"
    stay: str = "ICUSTAY_ID"
    item: str = "ITEMID"
    label: str = "LABEL"
    amount: str = "AMOUNT"


def dose_events(
    inputs: DataFrame, items: DataFrame, stays: DataFrame, c: DoseColumns = DoseColumns(),
    start: str = "INTIME", end: str = "OUTTIME", rows: int | None = None,
) -> DataFrame:
    """Dose rows with item label, category and the length of their stay in hours. ``rows`` of the inputs, if known, are not counted."""
    # Both lookups are stored, and measured as they are.
    with widened(inputs.sparkSession, rows or 0):
        stays, stays_size, _ = measured(
            stays.select(c.stay, hours_between(F.col(end), F.col(start)).alias("LOS_hours")), "stay-hours")
    labels, labels_size, _ = measured(items.select(*[x for x in (c.item, c.label, "CATEGORY") if x in items.columns]), "labels")
    labelled = lookup_join(inputs, labels, [c.item], "left", small_size=labels_size, big_rows=rows)
    return lookup_join(labelled, stays, [c.stay], "left", small_size=stays_size, big_rows=rows)


def dose_stats_stay(events: DataFrame, c: DoseColumns = DoseColumns(), sizes: tuple[int, int] | None = None) -> DataFrame:
    """Level 1. Rows with a NULL key are left out; the sum of no amount is 0.

    ``sizes`` are the most rows that a stay has of an item and all rows, if measured on the inputs, before the lookups.
    """
    keys = [c.subject, c.admission, c.stay, c.item, c.label]
    rows = events.dropna(subset=keys)
    a = F.col(c.amount)
    stats = [
        F.coalesce(F.sum(a), F.lit(0.0)).alias("Total_Amount"),
        F.avg(a).alias("Mean_Dose"),
        F.stddev_samp(a).alias("Std_Dose"),
        F.min(a).alias("Min_Dose"),
        F.max(a).alias("Max_Dose"),
        F.count(a).alias("Event_Count"),
        # One stay has one length, so any non-null value is the first.
        F.max("LOS_hours").alias("LOS_hours"),
    ]
    largest, total = sizes or group_sizes(rows, [c.stay, c.item])
    if largest <= BUILTIN_GROUP_ROWS:
        # Groups are small, so the middle rows are found in the same partitioning the sums need.
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(a.asc_nulls_last()))
        filled = F.count(a).over(Window.partitionBy(*keys))
        middle = F.col("__place").between(F.floor((F.col("__n") + 1) / 2), F.floor((F.col("__n") + 2) / 2))
        table = by_rows(rows, total, c.stay, c.item).withColumns({"__place": place, "__n": filled}).groupBy(*keys).agg(
            *stats, F.avg(F.when(middle, a)).alias("Median_Dose"))
    else:
        medians = grouped_quantiles(rows, keys, c.amount, {"Median_Dose": 0.5})
        table = rows.groupBy(*keys).agg(*stats).join(medians, keys, "left")
    return table.withColumn("Amount_per_LOS_hour", ratio(F.col("Total_Amount"), F.col("LOS_hours")))


def dose_stats_admission(stay_stats: DataFrame, c: DoseColumns = DoseColumns(), rows: int | None = None) -> DataFrame:
    """Level 2, from level 1. Level 1 has one row per stay, so counting rows counts stays. ``rows`` at most set the number of tasks."""
    t = F.col("Total_Amount")
    return by_rows(stay_stats, rows, c.admission, c.item).groupBy(c.subject, c.admission, c.item, c.label).agg(
        F.sum(t).alias("Total_Amount_Admission"),
        F.avg(t).alias("Mean_Per_Stay"),
        F.stddev_samp(t).alias("Std_Per_Stay"),
        F.sum("Event_Count").alias("Total_Events_Admission"),
        F.count(c.stay).alias("N_ICU_Stays"),
    )


def dose_stats_person(admission_stats: DataFrame, c: DoseColumns = DoseColumns(), rows: int | None = None) -> DataFrame:
    """Level 3, from level 2."""
    t = F.col("Total_Amount_Admission")
    return by_rows(admission_stats, rows, c.subject, c.item).groupBy(c.subject, c.item, c.label).agg(
        F.sum(t).alias("Total_Amount_All"),
        F.avg(t).alias("Mean_Per_Admission"),
        F.stddev_samp(t).alias("Std_Per_Admission"),
        F.sum("Total_Events_Admission").alias("Total_Events_All"),
        F.count(c.admission).alias("N_Admissions"),
        F.sum("N_ICU_Stays").alias("N_ICU_Stays_All"),
    )


def compute_statistics(inputs: DataFrame, items: DataFrame, stays: DataFrame,
                       c: DoseColumns = DoseColumns()) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = inputs.count()
    stay = dose_stats_stay(dose_events(inputs, items, stays, c, rows=rows), c)
    admission = dose_stats_admission(stay, c, rows)
    return stay, admission, dose_stats_person(admission, c, rows)


def person_totals(events: DataFrame, c: DoseColumns = DoseColumns()) -> DataFrame:
    """Admissions and stays of each person, counted over the person and not over one item."""
    keys = events.dropna(subset=[c.subject, c.admission, c.stay]).select(
        c.subject, c.admission, c.stay).distinct()
    per_admission = keys.groupBy(c.subject, c.admission).agg(F.count(F.lit(1)).alias("stays"))
    return per_admission.groupBy(c.subject).agg(
        F.count(F.lit(1)).alias("N_Admissions"), F.sum("stays").alias("N_ICU_Stays_All"))


def top_items(person_stats: DataFrame, k: int = 5, by: str = "Total_Amount_All",
              subject: str = "SUBJECT_ID", ties: Sequence[str] = ("ITEMID",)) -> DataFrame:
    """The k largest items of every person. Spark limits each map task to k rows per person first."""
    order = Window.partitionBy(subject).orderBy(F.col(by).desc(), *[F.col(t) for t in ties])
    return person_stats.withColumn("item_rank", F.row_number().over(order)).filter(F.col("item_rank") <= k)


def top_items_of(person_stats: DataFrame, subject_id, k: int = 5, by: str = "Total_Amount_All",
                 subject: str = "SUBJECT_ID", ties: Sequence[str] = ("ITEMID",)) -> DataFrame:
    one = person_stats.filter(F.col(subject) == F.lit(subject_id))
    return one.orderBy(F.col(by).desc(), *[F.col(t) for t in ties]).limit(k)
