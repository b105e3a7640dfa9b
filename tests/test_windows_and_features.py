from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stayloom.operators import codemap, features, windows

START = datetime(2150, 1, 1)
DAY = timedelta(days=1)
MICRO = timedelta(microseconds=1)


def events(spark, data):
    return spark.createDataFrame(data, "ICUSTAY_ID int, ITEMID int, CHARTTIME timestamp, VALUENUM double")


def reference(spark, ids=(1,)):
    return spark.createDataFrame(
        [(i, START, START + DAY) for i in ids], "ICUSTAY_ID int, INTIME timestamp, END_FIRST_24H timestamp")


def test_window_is_closed_on_both_ends(spark):
    times = [START - MICRO, START, START + DAY, START + DAY + MICRO]
    df = events(spark, [(1, i, t, 1.0) for i, t in enumerate(times)])
    assert rows(windows.filter_by_window(df, reference(spark)).select("ITEMID"), "ITEMID") == [(1,), (2,)]


def test_null_values_are_kept_on_request(spark):
    df = events(spark, [(1, 1, START, None), (1, 2, START, 2.0)])
    assert windows.filter_by_window(df, reference(spark)).count() == 1
    assert windows.filter_by_window(df, reference(spark), drop_null_values=False).count() == 2


def test_null_key_stays_in_base_and_leaves_reference(spark):
    base = spark.createDataFrame([(1, 7, START), (2, None, None)], "SUBJECT_ID int, ICUSTAY_ID int, INTIME timestamp")
    assert rows(windows.time_reference(base, "ICUSTAY_ID", ["ICUSTAY_ID", "INTIME"], "INTIME")) == [(7, START)]


def test_reference_has_one_row_per_id(spark):
    base = spark.createDataFrame(
        [(7, START + DAY, 2), (7, START, 1), (8, START, 3)], "ICUSTAY_ID int, INTIME timestamp, x int")
    ref = windows.time_reference(base, "ICUSTAY_ID", ["x", "ICUSTAY_ID", "INTIME"], "INTIME")
    assert rows(ref, "ICUSTAY_ID") == [(1, 7, START), (3, 8, START)]


def test_fan_out_counts_a_lab_for_each_stay(spark):
    labs = spark.createDataFrame([(5, START + DAY, 1.0)], "SUBJECT_ID int, CHARTTIME timestamp, VALUENUM double")
    ref = spark.createDataFrame(
        [(5, 1, START, START + DAY), (5, 2, START - 9 * DAY, START + 2 * DAY), (5, 3, START - DAY, START)],
        "SUBJECT_ID int, ICUSTAY_ID int, s timestamp, e timestamp")
    hits = windows.filter_by_windows(labs, ref, "SUBJECT_ID", "CHARTTIME", "s", "e", "VALUENUM")
    assert rows(hits.select("ICUSTAY_ID"), "ICUSTAY_ID") == [(1,), (2,)]


def test_windows_equal_a_plain_join_on_hot_keys(spark, tiny_limits):
    e = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7).alias("k"),
        F.timestamp_seconds(F.col("id") * 7919 % 864000).alias("t"), F.col("id").alias("v"))
    w = spark.range(40).select(
        (F.col("id") % 7).alias("k"), F.col("id").alias("w"),
        F.timestamp_seconds(F.col("id") * 20000).alias("s"), F.timestamp_seconds(F.col("id") * 20000 + 90000).alias("e"))
    got = windows.filter_by_windows(e, w, "k", "t", "s", "e", "v").groupBy("w").agg(F.count("*"), F.sum("v"))
    want = e.join(w, "k").filter("t BETWEEN s AND e").groupBy("w").agg(F.count("*"), F.sum("v"))
    assert rows(got, "w") == rows(want, "w")


def test_last_feature_keeps_a_shared_code(spark):
    m = {"a": [7, 1], "group": {"B (x)": [7]}}
    assert rows(codemap.code_map(spark, m).select("code", "feature_name"), "code") == [(1, "a"), (7, "b_x")]
    assert codemap.map_features(m) == ["a", "b_x"]
    assert codemap.map_features({"gone": [1], "kept": [1]}) == ["kept"]
    assert codemap.selected_codes(m) == [7, 1]


def test_bad_map_shape_is_an_error():
    with pytest.raises(ValueError):
        codemap.flatten_map({"a": 5})


def test_unknown_metric_is_an_error(spark):
    with pytest.raises(ValueError, match="median"):
        features.numeric_feature_table(events(spark, []), {"a": [1]}, metrics=("median",))


def test_latest_breaks_ties_by_value(spark):
    df = events(spark, [(1, 1, START, 1.0), (1, 1, START, 2.0), (1, 1, START - DAY, 9.0)])
    wide = features.numeric_feature_table(df, {"f": [1]}, metrics=("latest",))
    assert rows(wide) == [(1, 2.0)] and wide.columns == ["ICUSTAY_ID", "f_latest"]


def test_wide_table_has_fixed_columns_and_null_counts(spark):
    df = events(spark, [(1, 1, START, 4.0), (1, 1, START, 6.0)])
    wide = features.numeric_feature_table(df, {"f": [1], "absent": [2]}, metrics=("sum", "count", "avg"))
    assert wide.columns == ["ICUSTAY_ID", "f_sum", "absent_sum", "f_count", "absent_count", "f_avg", "absent_avg"]
    assert rows(wide) == [(1, 10.0, None, 2, None, 5.0, None)]


def test_occurrence_is_zero_among_ids_with_events_and_null_after_the_join(spark):
    df = events(spark, [(1, 1, START, None), (1, 1, START, None), (2, 2, START, None), (3, 99, START, None)])
    wide = features.occurrence_feature_table(df, {"f": [1], "g": [2]})
    assert rows(wide, "ICUSTAY_ID") == [(1, 2, 0, 1, 0), (2, 0, 1, 0, 1)]
    base = spark.createDataFrame([(1,), (3,)], "ICUSTAY_ID int")
    joined = features.attach_feature_tables(base, [wide.select("ICUSTAY_ID", "f_num")], "ICUSTAY_ID")
    assert rows(joined, "ICUSTAY_ID") == [(1, 2), (3, None)]


def test_wide_properties(spark):
    df = spark.range(2000).select(
        (F.col("id") % 13).cast("int").alias("ICUSTAY_ID"), (F.col("id") % 5).cast("int").alias("ITEMID"),
        F.lit(START).alias("CHARTTIME"), (F.rand(1) * 100).alias("VALUENUM"))
    m = {"a": [0, 1], "b": [2]}
    wide = features.numeric_feature_table(df, m)
    assert wide.count() == wide.select("ICUSTAY_ID").distinct().count() == 13
    assert wide.filter("a_min > a_avg OR a_avg > a_max").count() == 0
    had = features.occurrence_feature_table(df, m)
    assert had.filter("(a_num > 0) <> (a_had = 1)").count() == 0


def test_hot_ids_give_the_same_table(spark, tiny_limits):
    df = spark.range(600).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 11).cast("int").alias("ICUSTAY_ID"),
        (F.col("id") % 4).cast("int").alias("ITEMID"), F.lit(START).alias("CHARTTIME"),
        F.col("id").cast("double").alias("VALUENUM"))
    ref = reference(spark, range(11))
    got = features.numeric_feature_table(
        windows.filter_by_window(df, ref), {"a": [0, 1], "b": [3]}, metrics=("min", "max", "sum", "count"))
    want = df.groupBy("ICUSTAY_ID").agg(
        *[agg(F.when(F.col("ITEMID").isin(c), F.col("VALUENUM"))) for agg in (F.min, F.max, F.sum) for c in ([0, 1], [3])],
        *[F.nullif(F.count(F.when(F.col("ITEMID").isin(c), 1)), F.lit(0)) for c in ([0, 1], [3])])
    want = want.join(got.select("ICUSTAY_ID"), "ICUSTAY_ID")
    assert rows(got, "ICUSTAY_ID") == rows(want, "ICUSTAY_ID")


def test_keywords_are_patterns_and_brackets_are_not_literal(spark):
    items = spark.createDataFrame(
        [(1, "Glucose 70-105", "Labs"), (2, "Glucose (70-105)", "Labs"), (3, None, None)],
        "itemid int, label string, category string")
    d = codemap.normalised_dictionary(items, ["LABEL", "CATEGORY", "DBSOURCE"])
    assert d.filter("ITEMID = 3").select("LABEL", "DBSOURCE").first() == ("", "")
    assert rows(codemap.search_items(d, ["GLUCOSE (70-105)"]).select("ITEMID")) == [(1,)]
    found = codemap.keyword_map(d, {"g": ["glucose"], "none": ["zzz"]})
    counts = codemap.code_counts(found, {"g": [], "none": []})
    assert rows(counts.select("feature_name", "n_codes", "code_sum"), "feature_name") == [("g", 2, 3), ("none", 0, 0)]
    assert rows(codemap.coverage(counts)) == [(1, 2)]
    assert rows(codemap.feature_codes(found)) == [(0, "g", 1), (0, "g", 2)]


def test_source_filter_exact_and_by_part(spark):
    d = spark.createDataFrame([(1, "carevue", "a"), (2, "metavision", "a"), (3, "metavision 2", "b")],
                              "ITEMID int, DBSOURCE string, CATEGORY string")
    assert codemap.source_filtered(d, "metavision").count() == 2
    assert rows(codemap.category_counts(d, "metavision")) == [("a", 1)]


def test_windows_of_all_lengths_lie_in_two_buckets(spark):
    day = datetime(2020, 1, 1)
    spans = [(1, day, datetime(9998, 1, 1)), (1, day, day), (2, day - timedelta(days=400), day)] + [
        (3, day + timedelta(hours=h), day + timedelta(hours=h + 5 * (h % 9))) for h in range(300)]
    stays = [(1, day), (1, day + timedelta(days=365_000)), (2, day), (2, day + timedelta(seconds=1)), (4, day), (None, day)] + [
        (3, day + timedelta(hours=2 * h)) for h in range(160)]
    w = spark.createDataFrame(spans, "k long, s timestamp, e timestamp")
    e = spark.createDataFrame(stays, "k long, t timestamp")
    got = windows.filter_by_windows(e, w, "k", "t", "s", "e")
    want = sorted((k, t, s, end) for k, t in stays for j, s, end in spans if k == j and s <= t <= end)
    assert sorted((r["k"], r["t"], r["s"], r["e"]) for r in got.collect()) == want


def test_active_at_counts_open_intervals(spark):
    from stayloom.operators.clinical import active_at

    day = datetime(2020, 1, 1)
    rx = [(1, day, datetime(9998, 1, 1)), (1, day, day), (1, day + timedelta(days=2), day + timedelta(days=1)), (1, None, day), (2, day, day)] + [
        (3, day + timedelta(hours=h % 50), day + timedelta(hours=h % 50 + h % 7)) for h in range(400)]
    stays = [(1, 10, day), (1, 11, day + timedelta(seconds=1)), (1, 12, None), (None, 13, day), (5, 14, day)] + [
        (3, 100 + h, day + timedelta(hours=h)) for h in range(60)] + [(3, 100, day)]
    got = active_at(spark.createDataFrame(stays, "k long, stay long, at timestamp"),
                    spark.createDataFrame(rx, "k long, s timestamp, e timestamp"), "k", "stay", "at", "s", "e")
    want = sorted((i, sum(k == j and None not in (s, e, t) and s <= e and s <= t <= e for j, s, e in rx)) for k, i, t in stays)
    assert sorted(map(tuple, got.collect())) == want
