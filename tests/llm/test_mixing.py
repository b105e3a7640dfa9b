from __future__ import annotations

import pytest
from compare import connection, difference
from pyspark.sql import functions as F

from llm_fixtures import docs_of  # noqa: F401
from stayloom.llm.mixing import expand, mix, water_fill
from stayloom.llm.queries_mixing import ORACLES, QUERIES


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_agrees_with_its_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    assert difference(QUERIES["op1_mixture"](spark, folder), ORACLES["op1_mixture"], connection(folder)) is None


def filled(spark, rows, **kw):
    df = spark.createDataFrame(rows, "source string, source_size long, weight double")
    return {r["source"]: r["target"] for r in water_fill(df, **kw).collect()}


def test_excess_is_reshared_until_none_is_above(spark):
    got = filled(spark, [("a", 10, 3.0), ("b", 100, 1.0), ("c", 1000, 2.0)])
    # a is clamped at 20, then b at 200, and c takes the rest of 1.5 * 1110
    assert got == {"a": 20.0, "b": 200.0, "c": pytest.approx(1445.0)}


def test_weights_without_effect_and_empty_sources(spark):
    got = filled(spark, [("a", 10, 0.0), ("b", 0, 1.0), ("c", 90, None), ("d", 100, 1.0)])
    assert got == {"a": 0.0, "b": 0.0, "c": 0.0, "d": 200.0}
    assert filled(spark, []) == {}


def test_edges(docs_of):
    rows = [(i, "w " * (i % 40), "s" + str(i % 3)) for i in range(300)]
    rows += [(None, "x y z", "s0"), (None, None, "s1"), (7, "w w", "s1"), (7, "w w", "s1"), (900, "", None), (901, "a b c d", None),
             (902, None, "void"), (903, "long " * 50_000, "s2")]
    docs = docs_of(rows).withColumn("size", F.lit("clash")).withColumn("target", F.lit("clash"))
    got = mix(docs)
    assert got.columns.count("size") == 1 and got.columns.count("target") == 1
    out = got.collect()
    assert len(out) == len(rows)
    per = {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
        per.setdefault(r["source"], [r["target"], 0, 0])
        per[r["source"]][1] += r["taken"]
        per[r["source"]][2] += r["size"]
    assert sum(t for t, _, _ in per.values()) == pytest.approx(1.5 * sum(s for _, _, s in per.values()))
    assert per["void"] == [0.0, 0, 0]
    assert abs(per["s0"][1] - per["s0"][0]) <= 40 and abs(per["s1"][1] - per["s1"][0]) <= 40
    again = sorted((r["doc_id"] or -1, r["taken"]) for r in mix(docs.repartition(7)).collect())
    assert again == sorted((r["doc_id"] or -1, r["taken"]) for r in out)
    assert expand(got, ["doc_id"]).count() == sum(r["copies"] for r in out)
    assert mix(docs.limit(0)).count() == 0
