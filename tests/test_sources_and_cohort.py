from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stayloom.operators import clinical
from stayloom.plans import cohort
from stayloom.plans.statistics import association_report, select_and_fence
from stayloom.session import written
from stayloom.sources import readers, schemas, writers

T0 = datetime(2150, 1, 1)
HOUR = timedelta(hours=1)


def frame(spark, table, data, columns):
    declared = schemas.schema(table)
    types = {f.name: f.dataType for f in declared.fields}
    made = spark.createDataFrame(data, ", ".join(f"{c} {types[c].simpleString()}" for c in columns))
    return made.select(*[F.col(c) if c in columns else F.lit(None).cast(types[c]).alias(c) for c in declared.names])


@pytest.fixture(scope="module")
def tables(spark):
    t = {
        "PATIENTS": frame(spark, "PATIENTS", [(1, "F", datetime(2090, 1, 1), 0), (2, "M", datetime(2080, 1, 1), 1), (3, "M", T0, 0)],
                          ["SUBJECT_ID", "GENDER", "DOB", "EXPIRE_FLAG"]),
        "ADMISSIONS": frame(spark, "ADMISSIONS", [(1, 10, T0 - 5 * HOUR, "EMERGENCY", "FALL"), (2, 20, T0, "URGENT", None)],
                            ["SUBJECT_ID", "HADM_ID", "ADMITTIME", "ADMISSION_TYPE", "DIAGNOSIS"]),
        "ICUSTAYS": frame(spark, "ICUSTAYS", [(1, 10, 100, T0, T0 + 50 * HOUR, 2.1), (1, 10, 101, T0 + 60 * HOUR, T0 + 70 * HOUR, .4),
                                              (2, 20, 200, T0, T0 - HOUR, 1.0)],
                          ["SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "INTIME", "OUTTIME", "LOS"]),
        "CHARTEVENTS": frame(spark, "CHARTEVENTS", [(100, 211, T0, 80.0), (100, 211, T0 + 24 * HOUR, 100.0), (100, 211, T0 + 25 * HOUR, 1.0),
                                                    (200, 51, T0, 120.0), (200, 999, T0, 5.0)],
                             ["ICUSTAY_ID", "ITEMID", "CHARTTIME", "VALUENUM"]),
        "DATETIMEEVENTS": frame(spark, "DATETIMEEVENTS", [(100, 300, T0, T0), (100, 300, T0, T0), (100, 300, T0, None)],
                                ["ICUSTAY_ID", "ITEMID", "CHARTTIME", "VALUE"]),
        "LABEVENTS": frame(spark, "LABEVENTS", [(1, 400, T0 - 4 * HOUR, 1.5), (1, 400, T0 + 2 * HOUR, 1.7), (1, 400, T0 + 61 * HOUR, 2.5)],
                           ["SUBJECT_ID", "ITEMID", "CHARTTIME", "VALUENUM"]),
        "OUTPUTEVENTS": frame(spark, "OUTPUTEVENTS", [(100, 500, T0, 30.0), (100, 500, T0 + HOUR, 40.0)],
                              ["ICUSTAY_ID", "ITEMID", "CHARTTIME", "VALUE"]),
        "INPUTEVENTS_MV": frame(spark, "INPUTEVENTS_MV", [(1, 10, 100, 600, T0, 2.0), (2, 20, 200, 600, T0 + 30 * HOUR, 9.0)],
                                ["SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "ITEMID", "STARTTIME", "AMOUNT"]),
        "D_ITEMS": frame(spark, "D_ITEMS", [(211, "Heart Rate", "v"), (51, "Arterial BP [Systolic]", "v"), (300, "PICC Line Insertion Date", "l"),
                                            (500, "Foley", "o"), (600, "Propofol", "m"), (999, None, None)],
                         ["ITEMID", "LABEL", "CATEGORY"]),
        "D_LABITEMS": frame(spark, "D_LABITEMS", [(400, "Creatinine", "BLOOD", "C")], ["ITEMID", "LABEL", "FLUID", "CATEGORY"]),
    }
    from stayloom.operators.codemap import normalised_dictionary
    for d in ("D_ITEMS", "D_LABITEMS"):
        t[d] = normalised_dictionary(t[d], ["LABEL", "CATEGORY"])
    return t


def test_cohort_end_to_end(tables):
    wide = cohort.build_cohort(tables)
    got = {r["ICUSTAY_ID"]: r for r in wide.collect()}
    assert set(got) == {100, 101, 200, None} and wide.count() == 4
    assert (got[100]["heart_rate_min"], got[100]["heart_rate_avg"], got[100]["heart_rate_max"]) == (80.0, 90.0, 100.0)
    assert got[200]["systolic_bp_avg"] == 120.0 and got[101]["heart_rate_avg"] is None
    assert (got[100]["picc_line_num"], got[100]["picc_line_had"], got[101]["picc_line_num"]) == (2, 1, None)
    # The window of the second stay opens at the shared admission, so it sees the later lab too.
    assert (got[100]["creatinine_latest"], got[101]["creatinine_latest"]) == (1.7, 2.5)
    assert (got[100]["urine_foley_sum"], got[100]["urine_foley_count"]) == (70.0, 2)
    assert (got[100]["propofol_sum"], got[200]["propofol_sum"]) == (2.0, None)
    assert got[None]["GENDER"] == "M"


def test_given_maps_and_the_older_inputs(tables, spark):
    older = dict(tables, INPUTEVENTS_CV=frame(spark, "INPUTEVENTS_CV", [(100, 600, T0, 4.0)], ["ICUSTAY_ID", "ITEMID", "CHARTTIME", "AMOUNT"]))
    wide = cohort.build_cohort(older, {"inputs_older": {"any": [600]}}, ["inputs_older"])
    assert {r["ICUSTAY_ID"]: r["any_sum"] for r in wide.collect()}[100] == 4.0


def test_warehouse_tables(spark, tables):
    writers.write_table(cohort.stay_windows(tables["ICUSTAYS"]), "stay_windows")
    writers.write_events_table(cohort.windowed_events(tables["CHARTEVENTS"], readers.read_table(spark, "stay_windows")),
                               "events_24h", "ICUSTAY_ID", 4)
    assert readers.read_table(spark, "events_24h").count() == 4
    plan = readers.read_table(spark, "events_24h").groupBy("ICUSTAY_ID").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    writers.write_table(spark.range(3), "stay_windows")
    assert spark.table("stay_windows").count() == 3


def test_csv_with_declared_schema(spark, tables, tmp_path):
    path = str(tmp_path / "ICUSTAYS.csv")
    writers.write_csv(tables["ICUSTAYS"], path)
    back = readers.read_table_csv(spark, str(tmp_path), "ICUSTAYS")
    assert back.schema == tables["ICUSTAYS"].schema
    assert sorted(rows(back), key=str) == sorted(rows(tables["ICUSTAYS"]), key=str)
    part = readers.read_table_csv(spark, str(tmp_path), "ICUSTAYS", ["ICUSTAY_ID", "LOS"])
    assert part.columns == ["ICUSTAY_ID", "LOS"]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "INTIME" not in plan[plan.index("ReadSchema"):]
    with pytest.raises(KeyError):
        readers.read_table_csv(spark, str(tmp_path), "NOPE")


def test_csv_columns_are_matched_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"ROW_ID","los","SUBJECT_ID"\n1,2.5,7\n2,,8\n')
    df = readers.read_csv(spark, str(tmp_path / "x.csv"), "SUBJECT_ID int, LOS double, GONE string")
    assert rows(df, "SUBJECT_ID") == [(7, 2.5, None), (8, None, None)]
    assert readers.nullable_doubles(df).schema["SUBJECT_ID"].dataType.simpleString() == "double"


def test_source_fallback(spark, tmp_path):
    parquet, folder, file = (str(tmp_path / n) for n in ("p", "c", "f.csv"))
    chain = [("parquet", parquet), ("csv", folder), ("csv", file)]
    with pytest.raises(FileNotFoundError):
        readers.read_first_available(spark, chain)
    (tmp_path / "f.csv").write_text("a\n3\n")
    assert rows(readers.read_first_available(spark, chain, "a int")) == [(3,)]
    writers.write_csv(spark.createDataFrame([(2,)], "a int"), folder)
    assert rows(readers.read_first_available(spark, chain, "a int")) == [(2,)]
    writers.write_parquet(spark.createDataFrame([(1,)], "a int"), parquet)
    assert rows(readers.read_first_available(spark, chain, "a int")) == [(1,)]


def test_dictionaries_written_tables_and_answers(spark, tmp_path, capsys):
    (tmp_path / "D_ITEMS.csv").write_text("itemid,label,category\n1,Heart RATE,\n")
    (tmp_path / "D_LABITEMS.csv").write_text("ITEMID,LABEL,CATEGORY,FLUID\n2,,Chem,Blood\n")
    assert readers.read_items(spark, str(tmp_path)).select("ITEMID", "LABEL", "CATEGORY", "DBSOURCE").first() == (1, "heart rate", "", "")
    assert readers.read_lab_items(spark, str(tmp_path)).select("LABEL", "FLUID").first() == ("", "blood")
    df = written(spark.range(5), "numbers")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()
    writers.append_answers(spark.range(2), str(tmp_path / "a"))
    writers.append_answers(spark.range(1), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 3
    readers.describe(df)
    assert "rows: 5" in capsys.readouterr().out


def test_statistics_plan(spark):
    df = spark.range(200).select(
        (F.col("id") % 50 / 5.0).alias("LOS"), (F.col("id") % 50 + F.rand(1)).alias("a"), F.rand(2).alias("b"),
        F.when(F.col("id") % 50 > 25, "x").otherwise("y").alias("g"), F.lit("same").alias("h"))
    report = association_report(df)
    numeric = {r["feature"]: r for r in report.numeric.collect()}
    assert numeric["a"]["significant"] and not numeric["b"]["significant"]
    assert rows(report.categorical.select("feature", "test", "significant")) == [("g", "Mann-Whitney U", True)]
    assert report.ranking.first()["feature"] == "a"
    clean, missing = select_and_fence(df, ["LOS", "a", "zz"])
    assert missing == ["zz"] and clean.columns == ["LOS", "a", "LOS_log"] and clean.filter("LOS > 9.8").count() == 0


def test_clinical_extras(spark, tables):
    micro = spark.createDataFrame(
        [(1, "URINE", "STAPHYLOCOCCUS AUREUS", "OXACILLIN", "R"), (1, "URINE", None, None, None), (2, "SWAB", None, None, None)],
        "HADM_ID int, SPEC_TYPE_DESC string, ORG_NAME string, AB_NAME string, INTERPRETATION string")
    assert rows(clinical.resistance_flags(micro), "HADM_ID") == [(1, 1, 0, 0, 0), (2, 0, 0, 0, 0)]
    assert rows(clinical.confirmed_infection(micro), "HADM_ID") == [(1, 1), (2, 0)]
    assert rows(clinical.culture_counts(micro), "HADM_ID") == [(1, 2, 1), (2, 0, 0)]
    assert rows(clinical.forward_stays(tables["ICUSTAYS"]).select("ICUSTAY_ID"), "ICUSTAY_ID") == [(100,), (101,)]
    moves = tables["ICUSTAYS"].select("SUBJECT_ID", "INTIME", "OUTTIME")
    assert rows(clinical.merge_stays(moves, "SUBJECT_ID", "INTIME", "OUTTIME").select("SUBJECT_ID", "session", "n_rows"), "SUBJECT_ID") == [
        (1, 1, 2), (2, 1, 1)]
    callout = spark.createDataFrame([(T0, T0 + 5 * HOUR)], "CREATETIME timestamp, OUTCOMETIME timestamp")
    assert clinical.outcome_delay(callout).first()["ready_delay_hours"] == 5.0
    events = spark.createDataFrame([(1, 5), (1, 6), (1, 5), (1, None)], "ICUSTAY_ID int, CGID int")
    care = spark.createDataFrame([(5, "RN"), (6, "MD")], "CGID int, LABEL string")
    assert rows(clinical.caregiver_diversity(events, care)) == [(1, 2)]
    dx = spark.createDataFrame([(1, 1, "0389"), (1, 2, "4019")], "HADM_ID int, SEQ_NUM int, ICD9_CODE string")
    titles = spark.createDataFrame([("0389", "Septicemia"), ("4019", "Hypertension")], "ICD9_CODE string, LONG_TITLE string")
    assert rows(clinical.primary_diagnosis(dx).select("ICD9_CODE")) == [("0389",)]
    assert rows(clinical.diagnosis_cohort(dx, titles, "septic")) == [(1,)]
    adm = spark.createDataFrame([(1,), (0,)], "HAS_CHARTEVENTS_DATA int")
    assert clinical.charted_admissions(adm).count() == 1


@pytest.mark.parametrize("gap", [1, 24, 100])
def test_merged_stays_equal_a_pass_in_time_order(spark, gap):
    import random
    rng = random.Random(gap)
    moves = [(k, T0 + timedelta(minutes=rng.randrange(60_000)), rng.randrange(-30, 3000)) for k in (1, 2) for _ in range(60)]
    data = [(k, s, None if d % 7 == 0 else s + timedelta(minutes=d)) for k, s, d in moves]
    want = []
    for k in (1, 2):
        reached = None
        for _, s, e in sorted((r for r in data if r[0] == k), key=lambda r: r[1]):
            e = max(s, e or s)
            if reached is None or s - reached >= timedelta(hours=gap):
                want.append([k, s, e, 0])
                reached = e
            reached = max(reached, e)
            want[-1][2], want[-1][3] = max(want[-1][2], e), want[-1][3] + 1
    df = spark.createDataFrame(data, "k int, s timestamp, e timestamp")
    got = rows(clinical.merge_stays(df, "k", "s", "e", gap).select("k", "started", "ended", "n_rows"), "k", "started")
    assert got == [tuple(w) for w in want]


def test_a_file_with_another_header_stops_the_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,A,B\n1,a,b\n")
    (tmp_path / "b.csv").write_text("ID,B,A\n2,b,a\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(tmp_path), "ID int, A string, B string").collect()


def test_scratch_drops_what_was_written(spark):
    import os

    from stayloom import session

    with session.scratch(spark):
        kept = session.written(spark.range(5), "five")
        (path,) = {os.path.dirname(f) for f in kept.inputFiles()}
        path = path.removeprefix("file://")
        assert kept.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
