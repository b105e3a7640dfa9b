from __future__ import annotations

import random
import re

import numpy as np
import pytest
from compare import connection, difference

from llm_fixtures import docs_of  # noqa: F401
from stayloom.llm import minhash
from stayloom.llm.queries_minhash import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.01"


def test_query_agrees_with_its_sql(spark):
    assert difference(QUERIES["op5_near_duplicates"](spark, SMALL), ORACLES["op5_near_duplicates"], connection(SMALL)) is None


def plain(elements, places):
    """The method shingle by shingle, with a permutation swapped in place."""
    best = [2**64 - 1] * places
    for e in elements:
        p = list(range(places))
        for j in range(places):
            d = int(minhash.mix(np.array([(int(e) + (j + 1) * int(minhash.GOLDEN)) % 2**64], dtype=np.uint64))[0])
            k = j + (((d & 0xFFFFFFFF) * (places - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            best[p[j]] = min(best[p[j]], (j << 32) | (d >> 32))
    return best


def test_signatures_equal_the_plain_method():
    r = np.random.default_rng(1)
    sets = [r.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 5, 40, 300, 0, 900)]
    assert [row.tolist() for row in minhash.signatures(sets, 32)] == [plain(s, 32) for s in sets]


def words(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingles(text, n):
    w = words(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_sets_have_the_sizes_of_plain_ones():
    r = random.Random(1)
    texts = ["a b a b A B", "", "  ", "Xé \x85y\nz", None, "the the the", "a\x0bb c"] + ["".join(r.choice("abAB \n\té") for _ in range(r.randint(0, 80))) for _ in range(300)]
    for n in (1, 2, 5):
        sets = minhash.shingle_sets(texts, n, minhash.Powers())
        assert [len(s) for s in sets] == [len(shingles(t, n)) for t in texts]
        assert len({s.tobytes() for s in sets}) == len({frozenset(shingles(t, n)) for t in texts})


def brute(rows, n, percent=80):
    sets = {i: shingles(t, n) for i, t in rows if i is not None}
    name = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    low, high = sorted((name[a], name[b]))
                    name = {k: low if v == high else v for k, v in name.items()}
    return name


@pytest.mark.parametrize("n", [2, 5])
def test_groups_agree_with_brute_force(spark, docs_of, monkeypatch, n):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(n)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, number = [], 0
    for family in range(12):
        text = r.choices(vocabulary, k=r.choice([3, 30, 120, 400]))
        for _ in range(r.choice([1, 2, 12, 40])):
            now = list(text)
            for _ in range(r.randint(0, max(1, len(now) // 18))):
                now[r.randrange(len(now))] = r.choice(vocabulary)
            if family % 3 == 0:
                text = now  # a chain of copies of copies
            rows.append((number, " ".join(now)))
            number += 1
    got = {x["doc_id"]: x for x in minhash.near_duplicates(docs_of(rows), size=n).collect()}
    want = brute(rows, n)
    assert {i: x["component_id"] for i, x in got.items()} == want and len(set(want.values())) < 0.7 * len(want)
    assert all(x["n_shingles"] == len(shingles(t, n)) for i, t in rows for x in [got[i]])


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "ONE two"), (7, "x y " * 60_000), (8, "X y " * 60_000), (None, "one"), (9, "a b c"), (9, "a b c")]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(docs_of(rows), size=2).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False), 6: (1, 6, True), 7: (2, 7, True),
                   8: (2, 7, False), None: (1, None, True), 9: (2, 9, True)}
    assert minhash.near_duplicates(docs_of(rows)).count() == len(rows)
    assert minhash.near_duplicates(docs_of([])).count() == 0
