from __future__ import annotations

import pytest
from compare import connection, difference
from pyspark.sql import functions as F

from stayloom.llm import urls
from stayloom.llm.queries_urls import ORACLES, QUERIES, RULES


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_agrees_with_its_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    assert difference(QUERIES["op9_urls"](spark, folder), ORACLES["op9_urls"], connection(folder)) is None


def test_list_rules_and_parts(spark):
    given = [
        ("http://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/19?q#f", "example.org", "/en/19", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://x.org", "x.org", "", None, "allow"), ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        ("http://x.com/de/a#b?c", "x.com", "/de/a", "com/de/", "block"), ("x.com/de/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://h?x/y://z.org/", "h", "", None, "allow"), ("a\nb://x.org/" + "p" * 100_000, "x.org", "/" + "p" * 100_000, "org/", "allow"), ("http://", "", "", None, "allow")]
    pages = spark.createDataFrame([(i, g[0], "extra") for i, g in enumerate(given)] + [(0, given[0][0], "extra")], "page_id long, url string, verdict string")
    got = urls.judge(pages, RULES, min_confidence=1.1).collect()
    assert len(got) == len(given) + 1
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {i: g[1:] for i, g in enumerate(given)}


def test_mined_rules(spark):
    rows = [(["a", "b"], "block")] * 9 + [(["a", "b"], "allow")] + [(["a", "c"], "allow")] * 10 + [(["d"], "block")]
    mined = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.1, min_confidence=0.8)
    got = {(tuple(r["needs"]), r["verdict"], r["key"], round(r["confidence"], 3), r["support"]) for r in mined.collect()}
    assert got == {(("b",), "block", "b", 0.9, 9), (("a", "b"), "block", "b", 0.9, 9), (("c",), "allow", "c", 1.0, 10), (("a", "c"), "allow", "c", 1.0, 10)}


def test_mined_rules_decide_where_no_list_rule_fits(spark):
    rows = [(i, f"http://x{i}.spam.org/a") for i in range(20)] + [(100 + i, f"http://y{i}.fine.org/b") for i in range(20)]
    rows += [(200, "http://q.spam.net/zzz"), (201, "http://q.fine.net/zzz"), (202, "http://q.other.net/"), (203, None), (None, "http://q.spam.net/"), (None, "http://q.spam.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = urls.judge(pages, [("block", "spam.org/"), ("allow", "fine.org/")], min_support=0.1)
    by = {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()}
    assert [by[i] for i in (200, 201, 202, 203, None)] == [(None, "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block")]
    assert got.count() == len(rows) and got.filter(F.col("page_id").isNull()).count() == 2
    assert urls.judge(pages.limit(0), RULES).count() == 0
    plans = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plans and "Pandas" not in plans
