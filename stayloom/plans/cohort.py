"""From relational tables to one wide row per ICU stay."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CHART_SEARCH, DATED_SEARCH, INPUT_SEARCH, LAB_SEARCH, OUTPUT_SEARCH
from ..operators.codemap import keyword_map
from ..operators.features import attach_feature_tables, numeric_feature_table, occurrence_feature_table
from ..operators.skew import left_join_many, lookup_join
from ..operators.windows import add_window_end, filter_by_window, filter_by_windows, time_reference
from ..session import written

REFERENCE_COLUMNS = ["SUBJECT_ID", "ICUSTAY_ID", "ADMITTIME", "INTIME", "END_FIRST_24H"]


@dataclass(frozen=True)
class Preset:
    """How one event table becomes feature columns. Empty ``metrics`` means occurrence features."""

    table: str
    search: Mapping
    dictionary: str = "D_ITEMS"
    key: str = "ICUSTAY_ID"
    time: str = "CHARTTIME"
    start: str = "INTIME"
    value: str = "VALUENUM"
    metrics: tuple[str, ...] = ()
    many_windows: bool = False


PRESETS = {
    "charted": Preset("CHARTEVENTS", CHART_SEARCH, metrics=("min", "avg", "max")),
    "dated": Preset("DATETIMEEVENTS", DATED_SEARCH, value="VALUE"),
    "labs": Preset("LABEVENTS", LAB_SEARCH, "D_LABITEMS", key="SUBJECT_ID", start="ADMITTIME",
                   metrics=("latest",), many_windows=True),
    "outputs": Preset("OUTPUTEVENTS", OUTPUT_SEARCH, value="VALUE", metrics=("sum", "count")),
    "inputs": Preset("INPUTEVENTS_MV", INPUT_SEARCH, time="STARTTIME", value="AMOUNT", metrics=("sum", "count")),
    "inputs_older": Preset("INPUTEVENTS_CV", INPUT_SEARCH, value="AMOUNT", metrics=("sum", "count")),
}
DEFAULT_PRESETS = ("charted", "dated", "labs", "outputs", "inputs")


def base_table(patients: DataFrame, admissions: DataFrame, stays: DataFrame, hours: int = 24) -> DataFrame:
    """People, their admissions and stays; people without any stay in the table."""
    people = patients.select("SUBJECT_ID", "GENDER", "DOB", "EXPIRE_FLAG")
    visits = admissions.select("SUBJECT_ID", "HADM_ID", "ADMISSION_TYPE", "DIAGNOSIS", "ADMITTIME")
    icu = stays.select("HADM_ID", "ICUSTAY_ID", "INTIME", "LOS")
    joined = left_join_many(left_join_many(people, visits, ["SUBJECT_ID"]), icu, ["HADM_ID"])
    return add_window_end(joined, "INTIME", hours)


def stay_windows(stays: DataFrame, hours: int = 24) -> DataFrame:
    """Window of each stay, without NULL keys: the first materialised table of the warehouse build."""
    rows = stays.select("ICUSTAY_ID", "INTIME").dropna()
    return add_window_end(rows, "INTIME", hours)


def windowed_events(events: DataFrame, windows: DataFrame, value: str = "VALUENUM") -> DataFrame:
    """Events inside their stay's window: the second one, small enough to be read many times."""
    hits = filter_by_window(events, windows, value=value)
    return hits.select("ICUSTAY_ID", "ITEMID", "CHARTTIME", value)


def extract_in_windows(path: str, windows: DataFrame, key: str = "ICUSTAY_ID", time: str = "CHARTTIME", start: str = "INTIME",
                       end: str = "END_FIRST_24H", day: str = "day") -> DataFrame:
    """Events of an extract stored by day (``write_dated``) that lie in their stay's window; one window per stay.

    Windows are joined once for each day they touch. Where they are few enough to be broadcast, Spark reads the folders
    of their days only (dynamic partition pruning).
    """
    spark = windows.sparkSession
    days = windows.dropna(subset=[key, start, end]).filter(F.col(start) <= F.col(end)).select(
        key, start, end, F.explode(F.sequence(F.to_date(start), F.to_date(end))).alias(day))
    hits = lookup_join(spark.read.parquet(path), days, [key, day])
    return hits.filter(F.col(time).between(F.col(start), F.col(end))).drop(day)


def feature_table(events: DataFrame, preset: Preset, reference: DataFrame, features) -> DataFrame:
    """Window filter, code map, aggregation and pivot of one event table; one row per stay."""
    columns = [c for c in dict.fromkeys([preset.key, "ITEMID", preset.time, preset.value])]
    select = filter_by_windows if preset.many_windows else filter_by_window
    hits = select(events.select(*columns), reference, key=preset.key, time=preset.time, start=preset.start,
                  end="END_FIRST_24H", value=preset.value)
    if not preset.metrics:
        return occurrence_feature_table(hits, features)
    return numeric_feature_table(hits, features, value_column=preset.value, time_column=preset.time,
                                 metrics=preset.metrics)


def build_cohort(tables: Mapping[str, DataFrame], maps: Mapping[str, Mapping] | None = None,
                 presets=DEFAULT_PRESETS, hours: int = 24) -> DataFrame:
    """Base table with every feature table attached; their branches are one plan and run together.

    ``maps`` gives feature -> codes per preset; without it each map is the keyword search over its
    dictionary, joined as a table, and every searched feature has its columns.
    """
    base = base_table(tables["PATIENTS"], tables["ADMISSIONS"], tables["ICUSTAYS"], hours)
    # Every event table is joined to the windows, so they are computed once.
    reference = written(time_reference(base, "ICUSTAY_ID", REFERENCE_COLUMNS, "INTIME"), "windows")
    wide = []
    for name in presets:
        preset = PRESETS[name]
        features = maps[name] if maps else (
            keyword_map(tables[preset.dictionary], preset.search), list(preset.search))
        wide.append(feature_table(tables[preset.table], preset, reference, features))
    return attach_feature_tables(base, wide, "ICUSTAY_ID")
