from __future__ import annotations

import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from stayloom.operators import carried, skew, windows
from stayloom.operators.gradient import ridge_by_gradients
from stayloom.operators import learn
from stayloom.plans.catalog import roundtrips
from stayloom.plans.cohort import extract_in_windows
from stayloom.session import measured, scratch
from stayloom.sources import writers
from stayloom.streaming.features import follow

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Ridge by gradients.

def vectors(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(label=y)).repartition(3)
    return learn.encoder(names, []).fit(df).transform(df)


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_gradients_agree_with_the_closed_form(spark, alpha):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) * [1, 100, 0.01, 5, 1, 1] + [0, 5000, 3, 0, 1, 0]
    x[:, 4] = x[:, 3] > 2
    y = x @ [1, -0.02, 30, 0.1, 2, 0] + 7 + rng.normal(size=300)
    df = vectors(spark, x, y)
    model = ridge_by_gradients(df, 6, alpha)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(6), xc.T @ yc)
    assert model.coefficients == pytest.approx(want, rel=1e-7, abs=1e-8)
    assert model.intercept == pytest.approx(y.mean() - x.mean(0) @ want, rel=1e-7)
    if alpha:
        normal = learn.ridge(df, alpha)
        both = normal.transform(df).select("x0", "prediction").toPandas().merge(model.transform(df).select("x0", "prediction").toPandas(), on="x0")
        assert np.abs(both["prediction_x"] - both["prediction_y"]).max() < 1e-6


def test_ridge_of_many_slots(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(5)
    n, d = 250, 20_000
    hot = [np.unique(rng.integers(0, d, 6)) for _ in range(n)]
    value = [rng.normal(size=len(h)) for h in hot]
    x = np.zeros((n, d))
    for i, (h, v) in enumerate(zip(hot, value)):
        x[i, h] = v
    y = rng.normal(size=n) + x[:, hot[0]].sum(axis=1)
    df = spark.createDataFrame([(float(t), Vectors.sparse(d, h.tolist(), v.tolist())) for t, h, v in zip(y, hot, value)], ["label", "features"])
    named = df.select("label", F.col("features").alias("features", metadata={"ml_attr": {"num_attrs": d}}))
    model = learn.ridge(named)
    xc, yc = x - x.mean(0), y - y.mean()
    want = xc.T @ np.linalg.solve(xc @ xc.T + np.eye(n), yc)
    assert len(model.coefficients) == d and np.abs(model.coefficients - want).max() < 1e-8
    scored = model.transform(named).select("label", "prediction").toPandas()
    assert sorted(scored["prediction"]) == pytest.approx(sorted(model.intercept + x @ want), abs=1e-7)


def test_ridge_of_no_rows_and_one_value(spark):
    df = vectors(spark, np.ones((4, 2)), np.full(4, 3.0))
    model = ridge_by_gradients(df, 2, 1.0)
    assert model.intercept == pytest.approx(3.0) and not model.coefficients.any()
    assert ridge_by_gradients(df.limit(0), 2, 1.0).intercept == 0.0


# Hot on both sides.

def test_grid_join_equals_a_join_and_bounds_its_tasks(spark, tiny_limits):
    left = spark.range(500).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("b"))
    want = sorted(rows(left.join(right, "k").select("k", "a", "b")))
    got = skew.grid_join(left, right, ["k"])
    assert sorted(rows(got.select("k", "a", "b"))) == want
    # More than 300 and 200 rows of one key, cut to about 20 of either side in each of 16 x 11 tasks.
    for side in skew.grid_sides(left, right, ["k"], 500):
        sizes = [r["count"] for r in side.filter("k = 1").groupBy("__m_strip", "__n_strip").count().collect()]
        assert len(sizes) == 16 * 11 and max(sizes) < 45


def test_windows_of_one_key_with_many_events_and_windows(spark, tiny_limits):
    e = spark.range(400).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), F.col("id").alias("v"))
    w = spark.range(120).select(F.lit(1).alias("k"), F.col("id").alias("w"), F.timestamp_seconds(F.col("id") * 200).alias("s"),
                                F.timestamp_seconds(F.col("id") * 200 + 900).alias("e"))
    got = windows.filter_by_windows(e, w, "k", "t", "s", "e", "v").groupBy("w").agg(F.count("*"), F.sum("v"))
    want = e.join(w, "k").filter("t BETWEEN s AND e").groupBy("w").agg(F.count("*"), F.sum("v"))
    assert rows(got, "w") == rows(want, "w")


# Laid-out storage.

@pytest.fixture
def extract(spark, tmp_path):
    day = datetime(2024, 3, 1)
    events = [(k % 9, day + timedelta(hours=5 * k), float(k)) for k in range(300)] + [(1, None, 1.0), (None, day, 2.0)]
    stays = [(2, day + timedelta(days=4)), (3, day + timedelta(days=5, hours=20)), (4, None), (None, day)]
    df = spark.createDataFrame(events, "ICUSTAY_ID int, CHARTTIME timestamp, VALUENUM double")
    w = spark.createDataFrame(stays, "ICUSTAY_ID int, INTIME timestamp")
    return df, windows.add_window_end(w, "INTIME", 24), str(tmp_path / "dated")


def test_only_the_days_of_the_windows_are_read(spark, extract):
    events, w, path = extract
    writers.write_dated(events, path, "CHARTTIME")
    got = extract_in_windows(path, w)
    want = windows.filter_by_window(events, w)
    assert sorted(rows(got.select("ICUSTAY_ID", "CHARTTIME", "VALUENUM"))) == sorted(rows(want.select("ICUSTAY_ID", "CHARTTIME", "VALUENUM")))
    assert got.count() > 0 and "dynamicpruning" in plan_of(got).lower()
    got.collect()
    scan = got._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(day" in plan_of(got) or "dynamicpruningexpression(day" in plan_of(got)
    assert scan is not None


def test_bucketed_tables_join_without_a_shuffle(spark):
    df = roundtrips.QUERIES["bucketed_join"](spark, SMALL)
    plan = plan_of(df)
    below = plan[plan.index("SortMergeJoin"):]
    assert "Exchange" not in below and "Bucketed: true" in below
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("roundtrip_")]


def files(path):
    return {os.path.join(r, f): os.stat(os.path.join(r, f)).st_mtime_ns for r, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_keeps_one_row_a_key_and_leaves_other_folders_alone(spark, tmp_path):
    path = str(tmp_path / "answers")
    make = lambda pairs, seq: spark.createDataFrame([(k, c, seq) for k, c in pairs], "diagnosis string, category string, seq int")
    writers.upsert_answers(make([(f"d{i}", "old") for i in range(50)], 1), path, "diagnosis", "seq", 8)
    before = files(path)
    writers.upsert_answers(make([("d7", "new"), ("d7", "newer")], 3), path, "diagnosis", "seq", 8)
    after = files(path)
    touched = {os.path.dirname(f) for f in before.keys() ^ after.keys()}
    assert len(touched) == 1 and all(after[f] == t for f, t in before.items() if os.path.dirname(f) not in touched)
    writers.upsert_answers(make([("d7", "late"), ("x", "first")], 2), path, "diagnosis", "seq", 8)
    table = spark.read.parquet(path)
    got = {r["diagnosis"]: r["category"] for r in table.collect()}
    assert table.count() == 51 and got["d7"] == "newer" and got["x"] == "first" and got["d8"] == "old"
    writers.upsert_answers(make([], 4), path, "diagnosis", "seq", 8)
    assert spark.read.parquet(path).count() == 51


# Carried profiles.

def test_carried_profile_of_loads_with_nulls(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.gamma(2, 50, 20_000), 1)
    pdf = pd.DataFrame({"x": x, "load": rng.integers(0, 4, len(x))})
    pdf.loc[rng.random(len(x)) < 0.1, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("empty", F.lit(None).cast("double"))
    states = [carried.profile_state(df.filter(F.col("load") == k), ["x", "empty"]) for k in range(5)]  # the last load has no row
    state = states[0]
    for s in states[1:]:
        state = carried.merged_state(state.unionByName(s))
    found = {r["feature"]: r for r in carried.read_profile(state, [0.25, 0.5, 0.9]).collect()}
    r, have = found["x"], pdf["x"].dropna()
    assert (r["n"], r["nulls"]) == (len(pdf), int(pdf["x"].isna().sum())) and (r["low"], r["high"]) == (have.min(), have.max())
    assert r["mean"] == pytest.approx(have.mean()) and r["std"] == pytest.approx(have.std())
    assert r["about_distinct"] == pytest.approx(have.nunique(), rel=0.04)
    for q, name in ((0.25, "q25"), (0.5, "q50"), (0.9, "q90")):
        assert abs((have <= r[name]).mean() - q) < 0.02
    assert found["empty"]["nulls"] == len(pdf) and found["empty"]["mean"] is None and found["empty"]["about_distinct"] == 0


# Streams.

def test_stream_of_late_and_repeated_files_equals_the_batch(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = datetime(2024, 1, 10)
    events = [(i, i % 5, "ab"[i % 2], day + timedelta(hours=i % 90), None if i % 11 == 0 else i * 0.5) for i in range(200)]
    late = [(1000 + i, i % 7, "a", day - timedelta(days=5), float(i)) for i in range(20)]
    schema = "event_id long, k long, feature string, ts timestamp, value double"
    for lot in (events[:120], events[100:150] + late, events[:120] + events[150:]):  # parts of each lot were there before
        spark.createDataFrame(lot, schema).repartition(2).write.mode("append").parquet(source)
        table = follow(spark, source, schema, target, state, ["k", "feature"], "event_id", "ts", "value")
    from stayloom.streaming.features import feature_sums
    want = spark.createDataFrame(events + late, schema).groupBy("k", "feature").agg(*feature_sums("value", "ts"))
    assert rows(table.select(*want.columns), "k", "feature") == rows(want, "k", "feature")
    again = follow(spark, source, schema, target, state, ["k", "feature"], "event_id", "ts", "value")
    assert rows(again.select(*want.columns), "k", "feature") == rows(want, "k", "feature")


# Measured writes.

def test_size_and_aggregates_come_from_the_write(spark):
    df = spark.range(50).select("id", F.when(F.col("id") % 5 > 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("s"))
    with scratch(spark):
        stored, size, more = measured(df, "m", top=F.max("id"), holes=F.count_if(F.col("s").isNull()))
        assert size.rows == 50 and size.bytes == skew.measured_bytes(df) and more == {"top": 49, "holes": 10}
        assert stored.count() == 50
    empty, size, _ = measured(df.limit(0), "m")
    assert size.rows == 0 and size.bytes == 0 and empty.count() == 0


def test_dose_statistics_need_few_jobs(spark):
    from stayloom.plans.catalog import dose

    group = "dose-jobs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        dose.QUERIES["dose_stats_line"](spark, SMALL)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 12
