from __future__ import annotations

import numpy as np
import pytest
from compare import connection, difference

from stayloom.llm import neighbours, queries_neighbours, queries_search, search
from stayloom.llm.components import components

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("part", [queries_neighbours, queries_search])
def test_query_agrees_with_its_sql(spark, part):
    (name,) = part.QUERIES
    assert difference(part.QUERIES[name](spark, SMALL), part.ORACLES[name], connection(SMALL)) is None


def test_components_of_a_path_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 60)] + [(1, 2), (2, 3), (3, 1), (5, 5), (1, 2)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {(i, 100) for i in range(100, 161)} | {(i, 7) for i in [7, *range(20, 60)]} | {(i, 1) for i in (1, 2, 3)}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


SCHEMA = "vec_id long, embedding array<float>, label int, n_links long, score double"


def clustered(n=1500, dim=16, seed=1):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(n // 5, dim))
    x = centre[r.integers(len(centre), size=n)] + r.normal(size=(n, dim)) * 0.12
    return x.astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 9.0) for r in rows], SCHEMA)


def brute_links(rows, threshold=0.98):
    able = {}
    for i, x, k in rows:
        if i is not None and k is not None and x and None not in x:
            v = np.array(x, dtype=float)
            if np.isfinite(v).all() and v.any():
                able[i] = (v, k)
    near = {i: {j for j in able if j != i and able[i][1] == able[j][1] and len(able[i][0]) == len(able[j][0])
                and able[i][0] @ able[j][0] / (np.linalg.norm(able[i][0]) * np.linalg.norm(able[j][0])) >= threshold} for i in able}
    return near


def test_links_agree_with_brute_force_over_deep_forests(spark):
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(clustered())]
    near = brute_links(rows)
    got = {r["vec_id"]: r for r in neighbours.link(frame(spark, rows), leaf=20).collect()}
    pairs = sum(map(len, near.values()))
    assert pairs > 300 and sum(r["n_links"] for r in got.values()) >= 0.97 * pairs
    assert all(r["n_links"] <= len(near[i]) for i, r in got.items())


def test_large_groups_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    r = np.random.default_rng(2)
    one = r.normal(size=8)
    rows = [(i, (one + r.normal(size=8) * 0.01).astype(np.float32).tolist(), 1) for i in range(10, 100)]
    got = neighbours.link(frame(spark, rows), leaf=8).collect()
    assert {(x["n_links"], x["component_id"]) for x in got} == {(89, 10)} and sum(x["kept"] for x in got) == 1


def test_vectors_in_many_leaves_are_compared_in_little_memory():
    """All pairs of codes of 20,000 pairs were held at once: 340 MB for vectors in 120 leaves."""
    import tracemalloc

    import pandas as pd

    r = np.random.default_rng(4)
    x = (r.normal(size=16) + r.normal(size=(300, 16)) * 0.05).astype(np.float32)
    leaves = [np.r_[np.sort(r.choice(3000, 100, replace=False)), 5000, 7000 + i] for i in range(300)]
    table = pd.DataFrame({"rep": range(300), "embedding": list(x), "copies": r.integers(1, 4, 300), "leaves": leaves, "block": np.arange(300) % 2})
    tracemalloc.start()
    found = [neighbours.compare(table, 5000, *pair, 0.98).set_index("rep")["links"] for pair in ((0, 0), (0, 1), (1, 1))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30_000_000
    d = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = [sum(table["copies"][j] for j in range(300) if j != i and d[i] @ d[j] >= 0.98 and not set(leaves[i][:100]) & set(leaves[j][:100])) for i in range(300)]
    assert sum(want) > 300 and sum(f.reindex(range(300), fill_value=0) for f in found).tolist() == want


def test_a_dense_cluster_stays_in_few_leaves():
    """Borders through the middle of a cluster sent its vectors down both sides of node after node."""
    r = np.random.default_rng(5)
    x = np.r_[r.normal(size=(400, 32)) / 32 ** 0.5, r.normal(size=32) / 32 ** 0.5 + r.normal(size=(400, 32)) * 0.008]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = neighbours.codes_below(x, neighbours.fit_forest(x, 6, 0.98), 0)
    sizes = np.array([len(c) for c in codes])
    assert sizes[400:].mean() < 30 and max(map(len, (set(c) for c in codes[:400]))) < 64
    alone = neighbours.fit_forest(x[400:], 3, 0.98)
    assert np.isinf(alone.borders).any() and all(len(c) == neighbours.TREES for c in neighbours.codes_below(x[400:500], alone, 0))
    shared = [set(codes[i]) & set(codes[j]) for i in range(400, 480) for j in range(i) if x[i] @ x[j] >= 0.98]
    assert len(shared) > 3000 and np.mean([bool(s) for s in shared]) > 0.99


def test_link_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [2.0, 0.0], 1), (9, [1.0, 0.0], 2), (6, [1.0, 0.0], None), (7, None, 1), (8, [], 1),
            (10, [0.0, 0.0], 1), (11, [nan, 1.0], 1), (12, [inf, 1.0], 1), (13, [None, 1.0], 1), (None, [1.0, 0.0], 1), (14, [1.0, 0.0, 0.0], 1), (15, [-1.0, 0.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.link(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and got[3] == (2, 3, True) and got[4] == (2, 3, False) and got[5] == (2, 3, False)
    assert all(got[i] == (0, i, True) for i in (6, 7, 8, 9, 10, 11, 12, 13, 14, 15, None))
    twice = neighbours.link(frame(spark, [(1, [1.0, 0.0], 1)] * 2)).collect()
    assert [(r["n_links"], r["component_id"]) for r in twice] == [(1, 1), (1, 1)]
    assert neighbours.link(frame(spark, [])).count() == 0


def brute_nearest(rows, queries, k):
    able = {i: np.array(x, dtype=float) for i, x, _ in rows if i is not None and x and None not in x and np.isfinite(np.array(x, dtype=float)).all() and any(x)}
    out = set()
    for q in queries:
        if q in able:
            s = sorted((-float(np.add.accumulate(able[q] * able[j])[-1]), j) for j in able if j != q and len(able[j]) == len(able[q]))
            out |= {(q, n + 1, j, -d) for n, (d, j) in enumerate(s[:k])}
    return out


def asked(spark, rows, k, **kw):
    df = frame(spark, rows)
    return {tuple(r) for r in search.nearest(df, df.filter("vec_id % 10 = 0"), k=k, **kw).collect()}


def test_search_is_exact_at_factor_one_and_close_below(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD", 400)
    monkeypatch.setattr(search, "QUERIES", 60)
    monkeypatch.setattr(search, "LEAF", 16)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(clustered())]
    want = brute_nearest(rows, range(0, 1500, 10), 7)
    assert asked(spark, rows, 7) == want
    loose = asked(spark, rows, 7, factor=0.7)
    assert len({(q, v) for q, _, v, _ in loose} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)


def test_search_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 0), (20, [0.0, 0.0], 0), (30, None, 0), (1, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [2.0, 0.0], 0), (4, [nan, 1.0], 0),
            (5, [None, 1.0], 0), (6, [1.0, 0.0], 0), (6, [1.0, 0.0], 0), (None, [9.0, 9.0], 0), (7, [1.0, 1.0, 1.0], 0), (40, [1.0, 2.0, 3.0, 4.0], 0)]
    assert asked(spark, rows, 3) == {(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, 2.0)}
    assert asked(spark, rows, 9) == {(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, 2.0), (0, 4, 6, 1.0)}
    assert asked(spark, [], 3) == set()


def test_ties_of_different_vectors_across_the_cut(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD", 400)
    monkeypatch.setattr(search, "LEAF", 16)
    r = np.random.default_rng(4)
    one_hot = [(i, np.eye(24)[r.integers(24)].tolist(), 0) for i in range(300)]
    coarse = [(i, x.tolist(), 0) for i, x in enumerate(r.integers(-1, 2, size=(900, 6)).astype(float)) if x.any()]
    for rows in (one_hot, coarse):
        assert asked(spark, rows, 20) == brute_nearest(rows, range(0, 900, 10), 20)


def test_one_huge_norm_beside_unit_vectors(spark, monkeypatch):
    monkeypatch.setattr(search, "LEAF", 16)
    x = clustered(600).astype(float)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    for huge in (1e12, 1e30):
        rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(601, (x[5] * np.float32(huge)).tolist(), 0)]
        assert asked(spark, rows, 7) == brute_nearest(rows, range(0, 600, 10), 7)


def test_narrow_and_wide_labels_and_leaves_split_again(spark, monkeypatch):
    """One label in a small corner of the sphere beside wide ones; first trees so shallow that leaves are split again."""
    monkeypatch.setattr(neighbours, "LARGE", 1)
    r = np.random.default_rng(5)
    corner = (r.normal(size=16) + r.normal(size=(900, 16)) * 0.5).astype(np.float32)
    rows = [(i, x.tolist(), "wide") for i, x in enumerate(clustered(900))] + [(5000 + i, x.tolist(), "corner") for i, x in enumerate(corner)]
    rows += [(9000 + i, x.tolist(), "few") for i, x in enumerate(clustered(9, seed=4))]
    schema = SCHEMA.replace("label int", "label string")
    near = brute_links(rows)
    pairs = sum(map(len, near.values()))
    frame_ = spark.createDataFrame([(*x, 9, 9.0) for x in rows], schema)
    got = {x["vec_id"]: x for x in neighbours.link(frame_, leaf=60).collect()}
    assert pairs > 200 and sum(x["n_links"] for x in got.values()) >= 0.95 * pairs
    assert all(x["n_links"] <= len(near.get(i, ())) for i, x in got.items())


def test_codes_of_leaves_below_leaves():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = neighbours.fit_forest(x, 3, 0.98, 2)
    codes = neighbours.codes_below(x, forest, 0)
    paths = {int(c) & ((1 << neighbours.PATH) - 1) for own in codes for c in own}
    assert {int(c) >> neighbours.PATH for own in codes for c in own} == {0, 1} and paths <= set(range(8, 16))
    leaf = next(int(c) for own in codes for c in own if c >> neighbours.PATH == 1)
    below = neighbours.codes_below(x, neighbours.fit_forest(x, 2, 0.98, 1, (23, 1)), leaf)
    path = leaf & ((1 << neighbours.PATH) - 1)
    assert {int(c) for own in below for c in own} == {(1 << neighbours.PATH) | (path << 2 | k) for k in range(4)}


def test_vectors_of_any_length_are_linked(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [3e-200, 6e-200], 1), (3, [1.0, 2.0], 1), (4, [2.0, -1.0], 1), (5, [1.0, 2.1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.link(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}
