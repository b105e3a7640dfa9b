from __future__ import annotations

import random
import zlib

import pytest
from compare import connection, difference

from llm_fixtures import docs_of  # noqa: F401
from stayloom.llm import runs
from stayloom.llm.queries_runs import ORACLES, QUERIES, with_repeats

SMALL = "/root/testdata/sf0.01"


def test_query_agrees_with_its_sql(spark):
    assert difference(QUERIES["op12_runs"](spark, SMALL), ORACLES["op12_runs"], connection(SMALL)) is None


def brute(words, least=runs.LEAST, times=runs.TIMES):
    """Every stretch of equal words at every distance, kept if no smaller distance fits it."""
    n, found = len(words), {}
    for d in range(1, n // times + 1):
        i = 0
        while i < n - d:
            j = i
            while j < n - d and words[j] == words[j + d]:
                j += 1
            if j - i + d >= max(least, times * d) and j > i:
                found.setdefault((i, j - i + d), d)
            i = max(j, i + 1)
    return sorted(((s, m, d) for (s, m), d in found.items()), key=lambda r: (r[0], r[2]))


def texts(seed):
    r = random.Random(seed)
    for _ in range(60):
        words = [r.choice("ab") for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 4)):
            period = [r.choice("abcd") for _ in range(r.randrange(1, 12))]
            words += (period * 14)[:r.randrange(1, 90)] + [r.choice("abcxyz") for _ in range(r.randrange(0, 6))]
        yield words


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least, times", [(24, 3), (9, 3), (3, 3), (20, 4)])
def test_runs_equal_brute_force(seed, least, times):
    many = list(texts(seed))
    assert runs.runs_of(many, least, times) == [brute(w, least, times) for w in many]


def test_one_word_and_nested_periods():
    inner = ["a", "b"] * 6 + ["c"]
    many = [["x"] * 5000, inner * 40, [], ["x"] * 23, ["x"] * 24, [f"w{i % 500}" for i in range(1499)], [f"w{i % 500}" for i in range(1500)]]
    found = runs.runs_of(many)
    assert found[0] == [(0, 5000, 1)] and found[2] == found[3] == [] and found[4] == [(0, 24, 1)]
    assert found[1] == [(0, 520, 13)] and found[5] == [] and found[6] == [(0, 1500, 500)]


def test_fewer_than_three_periods_are_refused():
    with pytest.raises(ValueError):
        runs.runs_of([["a"]], 24, 2)


def test_collapse_keeps_the_first_period_of_each_run():
    words = ["s", *["a", "b", "c"] * 9, "t"]
    assert runs.collapse(words, runs.runs_of([words])[0]) == "s a b c t"


def test_edges(spark, docs_of):  # noqa: F811
    long = " ".join(f"w{i % 7}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "Hier nicht geteilt"), (5, "ja  nein\n" * 20), (5, "ja  nein\n" * 20), (None, "x " * 30), (7, long)]
    docs = docs_of(rows).withColumnRenamed("source", "runs").withColumnRenamed("score", "collapsed")
    found = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.find_runs(docs).collect())
    assert found == [
        (0, [(0, 30, 1)], "x"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [], "Hier nicht geteilt"),
        (5, [(0, 40, 2)], "ja nein"), (5, [(0, 40, 2)], "ja nein"), (7, [(0, 200_000, 7)], " ".join(f"w{i}" for i in range(7)))]
    assert runs.find_runs(docs.limit(0)).count() == 0
    assert runs.find_runs(docs).columns == ["doc_id", "text", "lang", "n_chars", "runs", "collapsed"]


def test_the_query_repeats_words_of_every_tenth_document(spark, docs_of):  # noqa: F811
    rows = [(i, " ".join(f"{i}w{k}" for k in range(i % 90))) for i in range(300)] + [(None, "a b c"), (9, None)]
    for r in with_repeats(docs_of(rows)).collect():
        words = next(t for i, t in rows if i == r["doc_id"] and (r["text"] is None) == (t is None))
        h = zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is None or h % 10 or not words:
            assert r["text"] == words
            continue
        w, g = words.split(), h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        assert r["text"].split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
