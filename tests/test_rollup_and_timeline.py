from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from stayloom.operators import rollup, timeline

T0 = datetime(2150, 1, 1)


@pytest.fixture
def doses(spark):
    inputs = spark.createDataFrame(
        [(1, 10, 100, 7, 2.0), (1, 10, 100, 7, 4.0), (1, 10, 101, 7, 10.0), (1, 11, 102, 7, 1.0),
         (2, 20, 200, 8, None), (2, 20, None, 8, 3.0), (2, 20, 200, 9, 3.0)],
        "SUBJECT_ID int, HADM_ID int, ICUSTAY_ID int, ITEMID int, AMOUNT double")
    items = spark.createDataFrame([(7, "prop", "drugs"), (8, "mida", "drugs")], "ITEMID int, LABEL string, CATEGORY string")
    stays = spark.createDataFrame(
        [(100, T0, T0 + timedelta(hours=3)), (101, T0, T0), (102, T0, None), (200, T0, T0 + timedelta(hours=1))],
        "ICUSTAY_ID int, INTIME timestamp, OUTTIME timestamp")
    return inputs, items, stays


@pytest.mark.parametrize("small", [False, True])
def test_three_levels(doses, request, small):
    if small:
        request.getfixturevalue("tiny_limits")
    stay, admission, person = rollup.compute_statistics(*doses)
    got = rows(stay.select("ICUSTAY_ID", "Total_Amount", "Mean_Dose", "Median_Dose", "Std_Dose", "Event_Count",
                           "LOS_hours", "Amount_per_LOS_hour"), "ICUSTAY_ID")
    assert got == [
        (100, 6.0, 3.0, 3.0, pytest.approx(2**.5), 2, 3.0, 2.0), (101, 10.0, 10.0, 10.0, None, 1, 0.0, None),
        (102, 1.0, 1.0, 1.0, None, 1, None, None), (200, 0.0, None, None, None, 0, 1.0, 0.0)]
    assert rows(admission.select("HADM_ID", "Total_Amount_Admission", "Mean_Per_Stay", "Total_Events_Admission",
                                 "N_ICU_Stays"), "HADM_ID") == [(10, 16.0, 8.0, 3, 2), (11, 1.0, 1.0, 1, 1), (20, 0.0, 0.0, 0, 1)]
    assert rows(person.select("SUBJECT_ID", "Total_Amount_All", "N_Admissions", "N_ICU_Stays_All"), "SUBJECT_ID") == [
        (1, 17.0, 2, 3), (2, 0.0, 1, 1)]
    total = lambda df, c: df.agg(F.sum(c)).first()[0]
    assert total(stay, "Total_Amount") == total(admission, "Total_Amount_Admission") == total(person, "Total_Amount_All")


def test_dose_levels_take_more_tasks_for_more_rows(doses, monkeypatch):
    """70 copies of the rows in tasks of 10: each level lies in more parts than the session's 8, with the same results."""
    from stayloom import session

    inputs, items, stays = doses
    many = inputs.crossJoin(inputs.sparkSession.range(70).withColumnRenamed("id", "copy")).select(
        (F.col("SUBJECT_ID") + 10 * F.col("copy")).alias("SUBJECT_ID"), (F.col("HADM_ID") + 1000 * F.col("copy")).alias("HADM_ID"),
        "ICUSTAY_ID", "ITEMID", "AMOUNT")
    want = [sorted(map(str, df.collect())) for df in rollup.compute_statistics(many, items, stays)]
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    levels = rollup.compute_statistics(many, items, stays)
    assert [sorted(map(str, df.collect())) for df in levels] == want
    assert min(df.rdd.getNumPartitions() for df in levels) > 8


def test_top_items_and_totals(doses):
    _, _, person = rollup.compute_statistics(*doses)
    assert rows(rollup.top_items(person, 1).select("SUBJECT_ID", "ITEMID", "item_rank"), "SUBJECT_ID") == [(1, 7, 1), (2, 8, 1)]
    assert rollup.top_items_of(person, 1, 5).count() == 1
    events = rollup.dose_events(*doses)
    assert rows(rollup.person_totals(events), "SUBJECT_ID") == [(1, 2, 3), (2, 1, 1)]


def brute_lowess(x, y, fraction):
    """One weighted line per row over its k nearest rows."""
    n, out = len(x), []
    k = int(fraction * n + 1e-10)
    for xi in x:
        near = np.argsort(np.abs(x - xi), kind="stable")[:k]
        h = np.abs(x[near] - xi).max()
        w = (1 - np.minimum(np.abs(x[near] - xi) / h, 1) ** 3) ** 3
        a = np.c_[np.ones(k), x[near] - xi] * np.sqrt(w)[:, None]
        out.append(np.linalg.lstsq(a, y[near] * np.sqrt(w), rcond=None)[0][0])
    return np.array(out)


@pytest.mark.parametrize("m", [10, 60])
def test_local_lines_equal_a_fit_over_single_rows(m, monkeypatch):
    rng = np.random.default_rng(m)
    counts = rng.integers(1, 4, m)
    xs = np.sort(rng.random(m))
    x = np.repeat(xs, counts)
    y = np.sin(6 * x) + rng.random(len(x))
    want = brute_lowess(x, y, .35)[np.cumsum(counts) - 1]
    means = np.array([y[x == v].mean() for v in xs])
    np.testing.assert_allclose(timeline.local_linear(xs, counts, means, .35), want, atol=1e-9)
    monkeypatch.setattr(timeline, "EXPANDED_ROWS", 0)
    monkeypatch.setattr(timeline, "MATRIX_CELLS", 50)
    np.testing.assert_allclose(timeline.local_linear(xs, counts, means, .35), want, atol=1e-9)


def test_local_lines_of_very_few_rows():
    x, one = np.array([0.1, 0.2]), np.array([1, 1])
    assert timeline.local_linear(x, one, np.array([3.0, 4.0]), .35).tolist() == [3.0, 4.0]
    assert timeline.local_linear(x[:1], np.array([5]), np.array([2.0]), .75).tolist() == [2.0]


@pytest.fixture
def stays_and_inputs(spark):
    stays = spark.createDataFrame([(1, T0), (2, T0)], "ICUSTAY_ID int, INTIME timestamp")
    rng = np.random.default_rng(1)
    data = []
    for s, n in ((1, 60), (2, 25)):
        for i in range(n):
            second = int(rng.integers(0, 2 * 86400)) if i else 86400
            data.append((s, T0 + timedelta(seconds=second - second % 600), float(rng.random()) + second / 86400))
    data += [(1, T0 + timedelta(hours=2), 0.0), (1, T0 + timedelta(hours=3), -1.0), (2, T0 + timedelta(hours=1), None)]
    return spark.createDataFrame(data, "ICUSTAY_ID int, STARTTIME timestamp, AMOUNT double"), stays, data


def test_window_of_one_day_and_trend(stays_and_inputs):
    inputs, stays, data = stays_and_inputs
    first = timeline.relative_events(inputs, stays)
    assert first.count() == sum(0 <= (t - T0).total_seconds() <= 86400 for _, t, _ in data)
    second = timeline.relative_events(inputs, stays, day=2)
    assert second.filter("Relative_Day < 0 OR Relative_Day > 1").count() == 0
    got = timeline.trend(first, stay="ICUSTAY_ID").toPandas().sort_values(["ICUSTAY_ID", "x"])
    for s in (1, 2):
        points = sorted(((t - T0).total_seconds() / 86400, a) for i, t, a in data
                        if i == s and (t - T0).total_seconds() <= 86400 and a is not None and a > 0)
        x, y = np.array(points).T
        want = dict(zip(x.round(9), brute_lowess(x, y, .35)))
        mine = got[got["ICUSTAY_ID"] == s]
        assert len(mine) == len(want)
        np.testing.assert_allclose(mine["trend"], [want[v] for v in mine["x"].round(9)], atol=1e-8)


@pytest.mark.parametrize("blocks", [False, True])
def test_bootstrap_band_surrounds_the_trend(stays_and_inputs, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(timeline, "WHOLE_STEPS", 5)
    inputs, stays, _ = stays_and_inputs
    events = timeline.relative_events(inputs, stays)
    band = timeline.bootstrap_band(events, draws=50).toPandas()
    assert (band["lower"] <= band["upper"]).all() and not band.isna().any().any()
    smooth = timeline.trend(events, fraction=timeline.BAND_FRACTION).toPandas()
    both = band.merge(smooth, on=["ICUSTAY_ID", "x"])
    assert len(both) == len(band) == len(smooth)
    assert ((both["lower"] <= both["trend"]) & (both["trend"] <= both["upper"])).mean() > .6


def test_trend_in_slices_and_band_in_any_layout(stays_and_inputs, monkeypatch):
    inputs, stays, _ = stays_and_inputs
    events = timeline.relative_events(inputs, stays, span_days=2.0)
    events = events.unionByName(events.limit(5))
    of = lambda df: sorted(map(tuple, df.collect()))
    smooth, band = of(timeline.trend(events)), of(timeline.bootstrap_band(events, draws=30))
    monkeypatch.setattr(timeline, "SLICE_POINTS", 7)
    monkeypatch.setattr(timeline, "WHOLE_STEPS", 5)
    monkeypatch.setattr(timeline, "DRAWS_PER_BLOCK", 4)
    np.testing.assert_allclose(of(timeline.trend(events)), smooth, rtol=1e-9)
    np.testing.assert_allclose(of(timeline.bootstrap_band(events.repartition(7), draws=30)), band, rtol=1e-9)
    assert of(timeline.bootstrap_band(events, draws=30, seed=1)) != band


def test_hashed_draws_have_mean_and_variance_one():
    c = timeline.poisson_draws("7", np.arange(2000), np.arange(200), 42)
    assert c.mean() == pytest.approx(1, abs=.01) and c.var() == pytest.approx(1, abs=.02)


def test_poisson_draws_have_mean_and_variance_one(spark):
    c = spark.range(200_000).select(timeline.poisson_one(F.rand(3)).alias("c")).agg(F.avg("c"), F.var_pop("c")).first()
    assert c[0] == pytest.approx(1, abs=.02) and c[1] == pytest.approx(1, abs=.03)
