from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from stayloom.functions import tails
from stayloom.operators import assoc


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 300
    y = rng.gamma(2, 2, n).round(1)
    pdf = pd.DataFrame({
        "id": range(n), "y": y, "a": (y + rng.normal(0, 2, n)).round(0), "b": rng.normal(size=n),
        "c": np.where(rng.random(n) < .4, 0.0, y), "d": rng.integers(0, 3, n).astype(float),
        "two": np.where(rng.random(n) < .5, "u", "v"), "many": rng.choice(list("pqrs"), n)})
    pdf.loc[::9, "a"] = np.nan
    pdf.loc[::11, "y"] = np.nan
    pdf.loc[::13, "many"] = None
    pdf.loc[0, "many"] = "once"
    pdf.loc[0, "y"] = 1.0
    return pdf, spark.createDataFrame(pdf).withColumns({c: F.nanvl(c, F.lit(None)) for c in "yabcd"})


def rank_corr(frame):
    f = frame.dropna()
    return f.iloc[:, 0].rank().corr(f.iloc[:, 1].rank())


@pytest.mark.parametrize("small", [False, True])
def test_spearman_with_target(table, request, small):
    if small:
        request.getfixturevalue("tiny_limits")
    pdf, df = table
    got = {r["feature"]: r for r in assoc.spearman_with_target(df, list("abcd"), "y").collect()}
    for c in "abcd":
        assert got[c]["rho"] == pytest.approx(rank_corr(pdf[[c, "y"]]), abs=1e-12)
        assert got[c]["n"] == len(pdf[[c, "y"]].dropna())
        assert got[c]["p_value"] == pytest.approx(tails.correlation_p(got[c]["rho"], got[c]["n"]))


def test_too_few_pairs_are_left_out(spark):
    df = spark.range(29).select(F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("y"))
    assert assoc.spearman_with_target(df, ["a"], "y").count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_rank_tests(table, request, small):
    if small:
        request.getfixturevalue("tiny_limits")
    pdf, df = table
    got = {r["feature"]: r for r in assoc.rank_tests(df, ["two", "many"], "y").collect()}

    f = pdf[["two", "y"]].dropna()
    r, g = f["y"].rank(), f["two"]
    n1, n2, n = (g == "u").sum(), (g == "v").sum(), len(f)
    u = r[g == "u"].sum() - n1 * (n1 + 1) / 2
    t = f["y"].value_counts()
    s = math.sqrt(n1 * n2 / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - .5) / s
    assert got["two"]["test"] == "Mann-Whitney U" and got["two"]["statistic"] == u
    assert got["two"]["p_value"] == pytest.approx(min(1.0, math.erfc(z / math.sqrt(2))), rel=1e-9)

    f = pdf[["many", "y"]].dropna()
    f = f[f["many"] != "once"]
    r, n = f["y"].rank(), len(f)
    sums, sizes = r.groupby(f["many"]).sum(), f.groupby("many").size()
    t = f["y"].value_counts()
    h = (12 / (n * (n + 1)) * (sums**2 / sizes).sum() - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))
    assert got["many"]["n_groups"] == 4 and got["many"]["statistic"] == pytest.approx(h, rel=1e-10)
    assert got["many"]["p_value"] == pytest.approx(tails.chi2_sf(h, 3))


def test_kruskal_of_a_textbook_example(spark):
    data = [("a", v) for v in (27., 2., 4., 18., 7., 9.)] + [("b", v) for v in (20., 8., 14., 36., 21., 22.)] + \
           [("c", v) for v in (34., 31., 3., 23., 30., 6.)]
    got = assoc.rank_tests(spark.createDataFrame(data, "g string, y double"), ["g"], "y").first()
    assert got["statistic"] == pytest.approx(2.854, abs=5e-4) and got["p_value"] == pytest.approx(0.2400, abs=5e-4)


@pytest.mark.parametrize(("got", "want"), [
    (tails.chi2_sf(3.841458820694124, 1), .05), (tails.chi2_sf(18.307038053275146, 10), .05),
    (tails.chi2_sf(200.0, 10), 1.4917e-37), (tails.t_two_sided(2.2281388519649385, 10), .05),
    (tails.t_two_sided(12.706204736432095, 1), .05), (tails.normal_two_sided(1.959963984540054), .05)])
def test_tail_probabilities(got, want):
    assert got == pytest.approx(want, rel=1e-3 if want < 1e-9 else 1e-9)


def test_exact_rank_sum_counts_all_arrangements(spark):
    from itertools import combinations as choose
    n1, n2 = 3, 5
    us = [sum(c) - n1 * (n1 + 1) // 2 + n1 for c in choose(range(n1 + n2), n1)]
    for u in range(8, 16):
        want = min(1.0, 2 * sum(x >= u for x in us) / len(us))
        assert tails.rank_sum_exact(u, n1, n2) == pytest.approx(want, abs=1e-12)
    assert tails.rank_sum_exact(15, 3, 5) == pytest.approx(2 / 56)
    data = [("a", v) for v in (1., 2., 3.)] + [("b", v) for v in (4., 5., 6., 7., 8.)]
    got = assoc.rank_tests(spark.createDataFrame(data, "g string, y double"), ["g"], "y").first()
    assert got["statistic"] == 0 and got["p_value"] == pytest.approx(2 / 56)


def test_false_discovery_rate(spark):
    df = spark.createDataFrame([("a", .01), ("b", .02), ("c", .03), ("d", .5), ("e", None)], "feature string, p_value double")
    got = rows(assoc.fdr_bh(df).select("feature", F.round("p_adj", 12), "significant"), "feature")
    assert got == [("a", .04, True), ("b", .04, True), ("c", .04, True), ("d", .5, False)]
    assert rows(assoc.test_counts(assoc.fdr_bh(df))) == [(4, 3, 3)]


def test_adjusted_p_is_monotone_and_not_smaller(spark):
    df = spark.range(50).select(F.concat(F.lit("f"), "id").alias("feature"), F.rand(2).alias("p_value"),
                                (F.col("id") % 2).alias("fam"))
    out = assoc.fdr_bh(df, family=["fam"]).toPandas().sort_values(["fam", "p_value"])
    assert (out["p_adj"] >= out["p_value"]).all()
    assert out.groupby("fam")["p_adj"].apply(lambda s: s.is_monotonic_increasing).all()


@pytest.mark.parametrize("small", [False, True])
def test_information_equals_a_count_by_hand(table, request, small):
    if small:
        request.getfixturevalue("tiny_limits")
    pdf, df = table
    got = {r["feature"]: r["MI"] for r in assoc.mutual_information(df, ["a", "d"], "y", 5).collect()}
    f = pdf.dropna(subset=["y"])
    for c in ("a", "d"):
        x = f[c].fillna(f[c].median())
        bx = ((x.rank(method="min") - 1) * 5 // len(f)).astype(int)
        by = ((f["y"].rank(method="min") - 1) * 5 // len(f)).astype(int)
        p = pd.crosstab(bx, by).to_numpy() / len(f)
        px, py = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            assert got[c] == pytest.approx(np.nansum(p * np.log(p / (px * py))), abs=1e-12)


@pytest.mark.parametrize("small", [False, True])
def test_matrix_is_pairwise_complete(table, request, small):
    if small:
        request.getfixturevalue("tiny_limits")
    pdf, df = table
    df = df.withColumn("same", F.lit(1.0))
    got = {(r[0], r[1]): r[2] for r in assoc.spearman_matrix(df, "id", ["a", "b", "c", "d", "same"]).collect()}
    assert len(got) == 25 and got[("same", "a")] == 0.0 and got[("a", "a")] == 1.0
    for x in "abcd":
        for y in "abcd":
            if x != y:
                assert got[(x, y)] == pytest.approx(rank_corr(pdf[[x, y]]), abs=1e-9)
    matrix = assoc.spearman_matrix(df, "id", ["b", "c", "d"])
    assert assoc.redundant_pairs(matrix.withColumn("rho", F.lit(-.8))).count() == 3


def test_wide_matrix_with_many_incomplete_columns(spark, tiny_limits):
    """50 columns, ten of them with NULLs, some of those never together; no row is repeated by pair."""
    rng = np.random.default_rng(8)
    n, names = 300, [f"f{i:02d}" for i in range(50)]
    base = rng.normal(size=(n, 50)).cumsum(axis=1)
    pdf = pd.DataFrame(np.round(base, 1), columns=names).assign(id=range(n))
    for i in range(10):
        pdf.loc[rng.random(n) < 0.3, names[5 * i]] = np.nan
    pdf.loc[:150, "f00"] = np.nan
    pdf.loc[151:, "f05"] = np.nan
    df = spark.createDataFrame(pdf).repartition(3)
    got = {(r[0], r[1]): r[2] for r in assoc.spearman_matrix(df, "id", names).collect()}
    ranked = pdf[names]
    assert len(got) == 2500 and got["f00", "f05"] == 0.0
    for a in names[::3] + ["f05", "f10"]:
        for b in names:
            if a != b and {a, b} != {"f00", "f05"}:
                both = ranked[[a, b]].dropna()
                assert got[a, b] == pytest.approx(rank_corr(both), abs=1e-9)
    plan = assoc.spearman_matrix(df, "id", names)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_matrix_takes_more_tasks_for_more_rows(spark, table, monkeypatch):
    """1500 ranks in tasks of 50: the wide rows lie in more parts than the session's 8, and its settings come back."""
    from stayloom import session

    _, df = table
    names = ["a", "b", "c", "d", "y"]
    want = sorted(map(tuple, assoc.spearman_matrix(df, "id", names).collect()))
    parts = []
    stored = assoc.written
    monkeypatch.setattr(session, "TASK_ROWS", 50)
    monkeypatch.setattr(assoc, "written", lambda wide, name: [out := stored(wide, name), parts.append(len(out.inputFiles()))][0])
    got = sorted(map(tuple, assoc.spearman_matrix(df, "id", names).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-12)
    assert parts and min(parts) > 8 and spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_ranking_and_selection(table):
    _, df = table
    rho = assoc.fdr_bh(assoc.spearman_with_target(df, list("abcd"), "y"))
    ranking = assoc.combined_ranking(assoc.mutual_information(df, list("abcd"), "y"), rho)
    scores = [r["score"] for r in ranking.collect()]
    assert scores == sorted(scores, reverse=True) and 0 < scores[-1] <= scores[0] <= 1
    assert assoc.strong_features(rho)[0] in ("a", "c")


def test_target_is_ranked_and_sent_once_for_all_features(spark, monkeypatch, tiny_limits):
    """Each feature sent the rows and ranked the target again, and joined its own ranks back to them."""
    r = np.random.default_rng(5)
    x = r.integers(0, 9, (400, 4)).astype(float)
    y = np.round(x[:, 0] + r.normal(size=400), 1)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y)
    pdf.loc[::3, "b"], pdf.loc[1::7, "c"], pdf.loc[::11, "y"], pdf["d"] = np.nan, np.nan, np.nan, 2.0
    df = spark.createDataFrame(pdf).withColumns({c: F.nanvl(c, F.lit(None)) for c in "ab"})
    found = assoc.rank_correlations(df, list("abcd"), "y")
    by_pairs = assoc.spearman_of(assoc.ranked_pairs(df, [(f, f, "y") for f in "abcd"]))
    old = {r["feature"]: (r["rho"], r["n"]) for r in by_pairs.collect()}
    got = {r["feature"]: (r["rho"], r["n"]) for r in found.collect()}
    assert set(got) == set(old) == set("abcd") and got["d"] == old["d"] and got["d"][0] is None
    for f in "abc":
        assert got[f] == (pytest.approx(old[f][0]), old[f][1])
    monkeypatch.setattr(assoc, "ranked_pairs", None)
    assert {r["feature"] for r in assoc.spearman_with_target(df, list("abcd"), "y").collect()} == set("abcd")


def test_bins_are_counted_without_sending_rows(spark):
    """Rows were joined to the ranks of both columns; now a row's bins come from the bins' first values."""
    r = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": r.normal(size=500), "b": r.integers(0, 3, 500).astype(float), "c": np.full(500, 1.0)})
    df = spark.createDataFrame(pdf.assign(y=np.round(pdf["a"] + r.normal(size=500), 1)))
    found = assoc.mutual_information(df, list("abc"), "y")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    old = dict(rows(assoc.binned_information(assoc.ranked_pairs(df, [(f, f, "y") for f in "abc"]))))
    assert dict(rows(found)) == pytest.approx(old)
