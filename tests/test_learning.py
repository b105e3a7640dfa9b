from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from stayloom.operators import evaluate, learn
from stayloom.operators.boost import Setting
from stayloom.plans.training import add_derived_vitals, compare_models, encode_split, refit_on_important, tree_search


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(4)
    n = 400
    hr, sbp = rng.normal(80, 10, n), rng.normal(120, 15, n)
    los = np.exp(hr / 60 + rng.normal(0, .1, n))
    pdf = pd.DataFrame({
        "SUBJECT_ID": rng.integers(0, 90, n), "ICUSTAY_ID": range(n), "GENDER": rng.choice(["F", "M"], n),
        "heart_rate_avg": hr, "systolic_bp_avg": sbp, "diastolic_bp_avg": sbp - 40, "LOS": los, "LOS_log": np.log1p(los)})
    pdf.loc[0, "LOS"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("LOS", F.nanvl("LOS", F.lit(None)))
    return encode_split(df, keep=["ICUSTAY_ID"])


def test_split_shares_no_person_and_never_uses_the_target(fitted):
    assert fitted.train.join(fitted.test, "SUBJECT_ID").count() == 0
    assert fitted.train.count() + fitted.test.count() == 399
    assert not any("LOS" in n or "ICUSTAY" in n or "SUBJECT" in n for n in fitted.names)
    train, validation = learn.validation_split(fitted.train)
    assert train.join(validation, "SUBJECT_ID").count() == 0 and validation.count() > 0
    assert {r[0] % 10 for r in validation.select("SUBJECT_ID").distinct().collect()} == {7}


def test_negative_ids_split_by_positive_remainder(spark):
    df = spark.createDataFrame([(-1,), (-5,)], "SUBJECT_ID int")
    assert rows(learn.split_by_subject(df)[0]) == [(-5,)]


def test_unseen_category_does_not_fail(spark, fitted):
    odd = spark.createDataFrame([(1, 1, "X", 0.0, 80.0, 120.0, 80.0, .7, 93.0, 40.0)],
                                "SUBJECT_ID int, ICUSTAY_ID int, GENDER string, label double, heart_rate_avg double,"
                                " systolic_bp_avg double, diastolic_bp_avg double, Shock_Index double, MAP_mean double,"
                                " Pulse_Pressure double")
    assert fitted.encoder.transform(odd).count() == 1


def test_derived_vitals(spark):
    df = spark.createDataFrame([(80.0, 0.0, 60.0)], "heart_rate_avg double, systolic_bp_avg double, diastolic_bp_avg double")
    r = add_derived_vitals(df).first()
    assert (r["Shock_Index"], r["MAP_mean"], r["Pulse_Pressure"]) == (None, 40.0, -60.0)


def test_ridge_equals_the_normal_equation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [1, 5, 20]
    y = x @ [1, -2, .1] + 3 + rng.normal(size=200)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(label=y)
    train = learn.encoder(list("abc"), []).fit(df := spark.createDataFrame(pdf)).transform(df)
    model = learn.ridge(train, 1.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(model.coefficients.toArray(), want, atol=1e-6)
    assert model.intercept == pytest.approx(y.mean() - x.mean(0) @ want, abs=1e-6)


def test_metrics_by_hand(spark):
    y, p = np.array([0.0, 1.0, 2.0, 3.0]), np.array([.5, 1.0, -1.0, 2.5])
    df = spark.createDataFrame(pd.DataFrame({"label": y, "prediction": p}))
    m = evaluate.metrics(df, "m").first()
    yd, pd_ = np.expm1(y), np.expm1(np.maximum(p, 0))
    e = yd - pd_
    assert m["mae"] == pytest.approx(np.abs(e).mean()) and m["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
    assert m["r2"] == pytest.approx(1 - (e**2).sum() / ((yd - yd.mean())**2).sum())
    assert m["median_ae"] == pytest.approx(np.median(np.abs(e)))
    assert m["mape"] == pytest.approx(np.abs(e / np.where(yd == 0, 1, yd)).mean() * 100)
    r = evaluate.residuals(df, cap=5.0).toPandas()
    assert r["actual"].max() == 5.0 and r["residual"].abs().max() <= 5.0


def test_permutation_importance_finds_the_driver(spark, fitted):
    model = learn.ridge(fitted.train)
    table = learn.permutation_importance(model, fitted.test, "ICUSTAY_ID", fitted.names).collect()
    assert len(table) == len(fitted.names)
    assert table[0]["feature"] in ("heart_rate_avg", "Shock_Index") and table[0]["importance"] > 0
    silent = fitted.test.withColumn("prediction", F.lit(0.0))
    assert silent.count() > 0


@pytest.mark.parametrize("n", [2, 10, 97, 1000])
def test_row_pairing_is_a_bijection(n):
    for a, b in learn._coprime_steps(n, 5, 1):
        assert len({(i * a + b) % n for i in range(n)}) == n


def test_search_chooses_the_smallest_error(fitted):
    train, validation = learn.validation_split(fitted.train)
    estimator = learn.tweedie(regularisation=.01)
    table, best = learn.search(estimator, learn.tweedie_grid(estimator, [1.5], [.01, 1.0]), train, validation, parallelism=2)
    scores = table.collect()
    assert [r["mae_log"] for r in scores] == sorted(r["mae_log"] for r in scores)
    assert best[estimator.regParam] == .01


SMALL = Setting(3, 0.3, 1.5)


def test_models_refit_and_saving(spark, fitted, tmp_path):
    table = compare_models(fitted, trees=8, setting=SMALL).collect()
    assert {r["model"] for r in table} == {"median", "ridge", "tweedie", "trees"}
    worst = {r["model"]: r["mae"] for r in table}
    assert worst["ridge"] < worst["median"] and worst["trees"] < worst["median"]
    importance, refit, kept = refit_on_important(fitted, "ICUSTAY_ID", SMALL, 5)
    assert kept and set(kept) <= set(fitted.names) and importance.count() == len(fitted.names)
    assert refit.names == kept and len(refit.trees) == 5
    table, final = tree_search(fitted, 3, 4, [SMALL, Setting(2, 0.1, 1.3)])
    assert table.count() == 2 and len(final.trees) == 4
    learn.save_model(fitted.encoder, str(tmp_path / "encoder"))


def test_registered_tree_queries_run_the_full_setting(spark, monkeypatch):
    """Trees, rate, depth and settings asked for, with few trees fitted."""
    from stayloom.operators import boost
    from stayloom.plans import training
    from stayloom.plans.catalog import learning

    asked, fit = [], boost.boost

    def small(train, names, settings, trees, *rest):
        asked.append((trees, *settings))
        return fit(train, names, settings, 2, *rest)

    monkeypatch.setattr(training, "boost", small)
    monkeypatch.setattr(learn, "boost", small)

    def settings(name):
        asked.clear()
        return learning.QUERIES[name](spark, "/root/testdata/sf0.001").collect()

    whole = [(500, Setting(6, 0.05, 1.5))]
    grid = (300, *[Setting(d, r, p) for d in (5, 6, 7) for r in (0.03, 0.05, 0.1) for p in (1.3, 1.5, 1.7)])
    for name in ("gbt_metrics", "native_importance", "tree_importance"):
        assert settings(name) and asked == whole
    assert {r["model"] for r in settings("all_models")} == {"median", "ridge", "tweedie", "trees"} and asked == whole
    assert settings("trees_selected") and asked == whole * 2
    assert len(settings("tree_search")) == 27 and asked == [grid]
    assert settings("final_metrics") and asked[0] == grid and len(asked) == 2 and asked[1][0] == 500
