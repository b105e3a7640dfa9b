from __future__ import annotations

import math
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stayloom.functions import numbers as num
from stayloom.functions.text import feature_name, feature_name_column, sanitised
from stayloom.operators import incremental, prepare, profile
from stayloom.plans.preparation import prepare as prepare_table


def test_even_median_is_interpolated(spark):
    df = spark.createDataFrame([(v,) for v in (1., 2., 3., 4., None)], "x double")
    imputer = prepare.MedianImputer.fit(df, ["x", "absent"])
    assert imputer.medians == {"x": 2.5}
    assert imputer.transform(df).filter("x IS NULL").count() == 0


def test_unseen_and_null_categories_are_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "g string")
    test = spark.createDataFrame([("b",), ("z",), (None,)], "g string")
    hot = prepare.OneHot.fit(train, ["g"])
    assert hot.transform(test).columns == ["g_a", "g_b", "g_c"]
    assert sorted(rows(hot.transform(test))) == [(0, 0, 0), (0, 0, 0), (0, 1, 0)]
    assert prepare.OneHot.fit(train, ["g"], drop_first=True).transform(train).columns == ["g_b", "g_c"]


@pytest.mark.parametrize(("at", "birth", "age"), [
    (datetime(2150, 1, 1), datetime(1850, 1, 1), 300), (datetime(2100, 6, 1, 8), datetime(2080, 6, 1, 9), 19),
    (datetime(2100, 6, 1, 9), datetime(2080, 6, 1, 9), 20)])
def test_age_counts_elapsed_days(spark, at, birth, age):
    df = spark.createDataFrame([(at, birth)], "a timestamp, b timestamp")
    days = (at - birth).days
    got = df.select(num.age_years(F.col("a"), F.col("b"))).first()[0]
    assert got == int(days / 365.25) and abs(got - age) <= 1
    assert df.select(num.capped_age(F.lit(got))).first()[0] == (90 if got > 89 else got)


def test_ratios_guard_zero_and_transforms_keep_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0)], "a double, b double")
    assert rows(df.select(num.ratio(F.col("a"), F.col("b")), num.log_target(F.col("a"), 30),
                          num.from_log(F.col("a") - 5))) == [(None, math.log1p(1.0), 0.0), (None, None, None)]
    assert rows(spark.createDataFrame([("1.5",), ("x",), (None,)], "t string").select(num.numeric(F.col("t")))) == [
        (1.5,), (None,), (None,)]


def test_fence_keeps_rows_without_target(spark):
    df = spark.createDataFrame([(float(v),) for v in range(100)] + [(None,)], "LOS double")
    low, high = prepare.outlier_bounds(df, "LOS")
    assert (low, high) == (0.0, pytest.approx(98.01))
    kept = prepare.within_bounds(df, "LOS", low, high)
    assert kept.count() == 100 and kept.filter("LOS IS NULL").count() == 1
    assert rows(prepare.flagged_counts(df, "LOS", low, high)) == [(0, 1, 101)]
    assert rows(prepare.before_after(df, kept, "LOS"), "step") == [("after", 100, 49.0, 49.0), ("before", 101, 49.5, 49.5)]


def test_category_map_trims_both_sides(spark):
    df = spark.createDataFrame([(" SEPSIS", 1), ("FALL ", 2), ("?", 3), (None, 4)], "DIAGNOSIS string, id int")
    m = spark.createDataFrame([("SEPSIS ", "infectious"), ("FALL", "trauma_injury")], "diagnosis string, category string")
    assert rows(prepare.map_category(df, m), "id") == [("infectious", 1), ("trauma_injury", 2), (None, 3), (None, 4)]


def test_names():
    assert feature_name("  Heart Rate/min (bpm)-x ") == "heart_rate_min_bpm_x"


def test_name_column_and_sanitiser(spark):
    df = spark.createDataFrame([("  Heart Rate/min (bpm)-x ",)], "n string")
    assert df.select(feature_name_column(F.col("n"))).first()[0] == "heart_rate_min_bpm_x"
    assert sanitised(spark.range(1).toDF("a:[b] (c)")).columns == ["a__b_ _c_"]
    with pytest.raises(ValueError):
        sanitised(spark.range(1).select(F.lit(1).alias("a:"), F.lit(2).alias("a;")))


def test_select_align_and_training_columns(spark):
    df = spark.range(1).select("id", F.lit(2).alias("b"))
    got, missing = prepare.select_existing(df, ["b", "zz", "id"])
    assert got.columns == ["b", "id"] and missing == ["zz"]
    like = spark.range(1).select(F.lit(0).alias("c"), F.lit(0).alias("b"))
    assert rows(prepare.align_columns(df, like)) == [(0, 2)]
    full = spark.range(1).select("id", *[F.lit(0).alias(c) for c in ("LOS", "LOS_log", "x", "y")])
    assert prepare.columns_to_train(full, "LOS", derived=["y"], drop=["id"]) == ["x"]


def test_profile_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "a"), (4, "b")], "x int, g string")
    assert rows(profile.null_profile(df)) == [("g", 1, 25.0), ("x", 0, 0.0)]
    assert rows(profile.value_counts(df, "g")) == [("a", 2), ("b", 1)]
    assert rows(profile.row_and_null_count(df, "g")) == [(4, 1, .25)]
    s = profile.summary(df, ["x"]).first()
    assert (s["count"], s["mean"], s["q25"], s["q50"], s["max"]) == (4, 2.5, 1.75, 2.5, 4.0)
    h = rows(profile.histogram(df, "x", 3), "bin")
    assert [r[3] for r in h] == [1, 1, 2] and h[0][1] == 1.0 and h[-1][2] == 4.0
    assert profile.numeric_columns(df) == ["x"] and profile.categorical_columns(df) == ["g"]
    same = spark.createDataFrame([(5,), (5,)], "x int")
    assert sum(r["n"] for r in profile.histogram(same, "x", 4).collect()) == 2


def test_growing_map(spark):
    df = spark.createDataFrame([(" A",), ("A",), ("B",), (None,)] + [(f"t{i}",) for i in range(120)], "DIAGNOSIS string")
    known = spark.createDataFrame([("B ", "x")], "diagnosis string, category string")
    new = incremental.unclassified(df, known)
    assert new.count() == 121
    sizes = sorted(len(r["texts"]) for r in incremental.requests(incremental.batched(new)).collect())
    assert sizes == [21, 50, 50]
    answers = spark.createDataFrame(
        [('{"results": [{"diagnosis": "A", "category": "renal"}]}',), ("oops",), ('{"x": 1}',)], "response string")
    parsed = incremental.parsed_answers(answers)
    assert rows(parsed) == [("A", "renal")]
    old = spark.createDataFrame([("A", "other", 1), ("C", "other", 2)], "diagnosis string, category string, seq int")
    merged = incremental.merged_map(old, parsed.withColumn("seq", F.lit(3)))
    assert rows(merged, "diagnosis") == [("A", "renal", 3), ("C", "other", 2)]


def test_preparation_end_to_end(spark):
    day = datetime(2150, 1, 1)
    schema = ("SUBJECT_ID int, EXPIRE_FLAG int, LOS double, DIAGNOSIS string, ADMISSION_TYPE string, DOB timestamp,"
              " ADMITTIME timestamp, heart_rate_avg double, propofol_sum double")
    data = [(1, 0, 2.0, "FALL", "EMERGENCY", datetime(2100, 1, 1), day, 80.0, None),
            (2, 0, 3.0, "SEPSIS", "ELECTIVE", datetime(2090, 1, 1), day, None, 5.0),
            (3, 0, 4.0, "FALL", "URGENT", datetime(1850, 1, 1), day, 90.0, None),
            (4, 1, 9.0, "FALL", "URGENT", day, day, 1.0, 1.0), (5, 0, None, "FALL", "URGENT", day, day, 1.0, 1.0),
            (6, 0, 5.0, None, "URGENT", day, day, 1.0, 1.0)]
    m = spark.createDataFrame([("FALL", "trauma"), ("SEPSIS", "infectious")], "diagnosis string, category string")
    out = prepare_table(spark.createDataFrame(data, schema), m, cap_age=True).orderBy("SUBJECT_ID")
    assert out.columns == ["SUBJECT_ID", "LOS", "heart_rate_avg", "propofol_sum", "age", "DIAGNOSIS_trauma",
                           "ADMISSION_TYPE_EMERGENCY", "ADMISSION_TYPE_URGENT"]
    assert rows(out) == [
        (1, 2.0, 80.0, 0.0, 49, 1, 1, 0), (2, 3.0, 85.0, 5.0, 59, 0, 0, 0), (3, 4.0, 90.0, 0.0, 90, 1, 0, 1)]


def test_repeated_texts_need_a_sequence(spark):
    m = spark.createDataFrame([("x", "zebra", 1), (" x", "ant", 2)], "diagnosis string, category string, seq int")
    df = spark.createDataFrame([("x",)], "DIAGNOSIS string")
    assert rows(prepare.map_category(df, m, sequence="seq")) == [("ant",)]
    with pytest.raises(ValueError):
        prepare.map_category(df, m)
