from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from stayloom.operators import ranks, skew


@pytest.fixture
def skewed(spark):
    """Half of the keys are one key, a third of the values are zero, some are missing."""
    rng = np.random.default_rng(3)
    n = 500
    pdf = pd.DataFrame({
        "id": range(n), "k": np.where(rng.random(n) < .5, 1, rng.integers(0, 9, n)),
        "x": np.where(rng.random(n) < .33, 0.0, rng.normal(size=n).round(2)),
        "y": rng.integers(0, 40, n).astype(float)})
    pdf.loc[::17, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_a_plain_join(spark, skewed, tiny_limits, how):
    _, big = skewed
    small = spark.createDataFrame([(1, "a"), (1, "b"), (4, "c")], "k int, name string").select(
        F.col("k").cast("long").alias("k"), "name")
    got = skew.lookup_join(big.select("id", "k"), small, ["k"], how)
    want = big.select("id", "k").join(small, "k", how)
    assert sorted(map(str, rows(got.select(*want.columns)))) == sorted(map(str, rows(want)))


def test_hot_keys_are_few_and_split(spark, skewed, tiny_limits):
    pdf, big = skewed
    hot = {r["k"]: r["__splits"] for r in skew.hot_keys(big, ["k"], len(pdf)).collect()}
    counts = pdf["k"].value_counts()
    assert hot == {k: -(-c // 20) for k, c in counts.items() if c > 20}


def test_measured_bytes_counts_text(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "a long, b string")
    assert skew.measured_bytes(df) == 2 * 24 + 3


def test_average_ranks_of_ties(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 2.0, 2.0, 2.0, 3.0]], "value double").withColumn("cell", F.lit(0))
    table = ranks.value_ranks(df.withColumn("k", F.lit(1)), ["k"])
    assert rows(table.select("value", "avg_rank", "below", "n"), "value") == [
        (1.0, 1.5, 0, 6), (2.0, 4.0, 2, 6), (3.0, 6.0, 5, 6)]


@pytest.mark.parametrize("cell_rows", [10, 60, 10_000])
def test_ranks_do_not_depend_on_the_cells(spark, skewed, cell_rows):
    pdf, df = skewed
    long = ranks.long_values(ranks.add_cells(df, ["x", "y"], cell_rows), ["x", "y"])
    got = {(r["feature"], r["value"]): r["avg_rank"] for r in ranks.value_ranks(long, ["feature"]).collect()}
    for c in ("x", "y"):
        for value, rank in zip(pdf[c], pdf[c].rank()):
            if not np.isnan(value):
                assert got[(c, value)] == rank


@pytest.mark.parametrize("group_rows", [0, 10_000])
def test_quantiles_are_exact_on_both_paths(spark, skewed, group_rows):
    pdf, df = skewed
    q = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = ranks.grouped_quantiles(df, ["k"], "y", q, group_rows, 30).toPandas().set_index("k").sort_index()
    want = pdf.groupby("k")["y"].quantile(list(q.values())).unstack()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-12)
    columns = ranks.quantile_values(df, ["x", "y"], q, group_rows=group_rows, cell_rows=30)
    for c in ("x", "y"):
        np.testing.assert_allclose(list(columns[c].values()), pdf[c].quantile(list(q.values())), rtol=1e-12)


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert ranks.quantile_values(df, ["x"], {"m": .5}) == {}


@pytest.mark.parametrize("cell_rows", [7, 10_000])
def test_dense_index_is_gapless(spark, skewed, cell_rows):
    _, df = skewed
    index = [r["i"] for r in ranks.dense_index(df.select("id"), ["id"], "i", cell_rows).orderBy("id").collect()]
    assert sorted(index) == list(range(500)) and index != list(range(500))


def test_percent_rank_average_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(v,) for v in [1.0, 1.0, 2.0, None]], "v double")
    got = rows(df.select("v", ranks.percent_rank_average("v").alias("p")), "v")
    assert got == [(None, None), (1.0, .5), (1.0, .5), (2.0, 1.0)]


def test_one_to_many_left_join_equals_a_plain_one(spark, skewed, tiny_limits):
    _, many = skewed
    many = many.select("k", "id").withColumn("k", F.when(F.col("id") % 50 != 0, F.col("k")))
    one = spark.createDataFrame([(1, "a"), (2, "b"), (77, "none"), (None, "null"), (None, "null 2")], "k long, name string")
    got, want = skew.left_join_many(one, many, ["k"]), one.join(many, "k", "left")
    assert got.columns == want.columns
    assert sorted(map(str, rows(got))) == sorted(map(str, rows(want)))


def test_left_rows_without_a_key_stay(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y")], "k long, w string")
    assert sorted(map(str, rows(skew.nulls_apart(left, right, ["k"])))) == [str((1, "a", "x")), str((None, "b", None))]
