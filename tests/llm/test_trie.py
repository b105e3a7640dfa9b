from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import connection, difference
from pyspark.sql import functions as F

from stayloom.llm import trie as T
from stayloom.llm.queries_trie import ORACLES, QUERIES, conversation_trie, with_shared_heads

SMALL = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_query_agrees_with_its_sql(spark):
    assert difference(QUERIES["op13_trie"](spark, SMALL), ORACLES["op13_trie"], connection(SMALL)) is None


def brute(turns, rebuilt=True):
    """The contract on lists of turns of each conversation."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (*t[:3], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))]
           for c, ts in own.items()}
    if rebuilt:
        heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - int(math.fmod(c, 20)), [])[:heads[c]] + ts[heads[c]:] for c, ts in own.items()}  # as SQL has it
    nodes = defaultdict(list)
    for c, ts in own.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    out = []
    for path, members in nodes.items():
        inside = [p for p in nodes if p[:len(path)] == path]
        leaves = [p for p in inside if not any(q[:-1] == p and q for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].split()) for p in inside if p)
        ends = ",".join(map(str, sorted(c for c in members if len(own[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                    sum(1 for p in nodes if p and p[:-1] == path), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def invented(seed):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-25, 130), 70):
        for t in range(r.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, r.choice([t, t, t, None, 1]), r.choice(["user", "assistant", None]), r.choice(["a b", "a", "b c d", "", None])))
    rows += [(7, 0, "user", "a")] * 5 + [(None, 0, "user", "a"), (140, None, None, None), (1000, 0, "user", "a b"), (1001, 1, "user", "a b")]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    """Turns with columns that clash with added ones."""
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, words string")


def queried(spark, monkeypatch, rows):
    monkeypatch.setattr("stayloom.llm.queries_trie.load", lambda *_: frame(spark, rows))
    return sorted([tuple(r[c] for c in COLUMNS) for r in conversation_trie(spark, "").collect()], key=str)


@pytest.mark.parametrize("seed", range(2))
def test_query_equals_brute_force(spark, monkeypatch, seed):
    rows = invented(seed)
    assert queried(spark, monkeypatch, rows) == brute(rows)


def test_hot_keys_and_divided_conversations(spark, monkeypatch, tiny_limits):
    """One conversation of many turns over several parts, one first turn of most conversations, joins with keys split."""
    rows = invented(5) + [(40, t, "user", f"t{t % 7}") for t in range(300)] + [(c, 0, "user", "hot") for c in range(200, 400)]
    assert queried(spark, monkeypatch, rows) == brute(rows)


def test_empty_table(spark, monkeypatch):
    assert queried(spark, monkeypatch, []) == []
    assert queried(spark, monkeypatch, [(None, 1, "user", "a")]) == []


@pytest.mark.parametrize("cells", [1, 64, 1 << 20])
def test_any_sketch_gives_the_same_nodes(spark, cells):
    rows = [r for r in invented(3) if r[0] is not None]
    nodes, ends = T.trie(frame(spark, rows), max_cells=cells)
    found = sorted([tuple(r[c] for c in COLUMNS[:-1]) for r in nodes.collect()], key=str)
    assert found == sorted([r[:-1] for r in brute(rows, rebuilt=False)], key=str)
    singles = nodes.filter("single").count()
    assert singles == 0 if cells == 1 else singles >= 0
    if cells == 1 << 20:
        assert nodes.filter("n_convs = 1 AND depth > 0 AND NOT single").count() == 0  # the sketch proves all of them
    assert ends.count() + nodes.filter("single").agg(F.sum("n_ends")).first()[0] == len({r[0] for r in rows}) if cells > 1 else True


def test_sketch_never_underestimates(spark):
    r = np.random.default_rng(2)
    a, b = r.integers(-2**62, 2**62, 3000), r.integers(-2**62, 2**62, 3000)
    twice = np.r_[a, a[:700]].tolist(), np.r_[b, b[:700]].tolist()
    bits = T.sketch(spark.createDataFrame(list(zip(*twice)), "a long, b long").repartition(5), 1 << 13)
    single = T.alone(bits, a, b, 1 << 13)
    assert not single[:700].any() and single[700:].mean() > 0.9


def test_blocks_of_ends_are_joined_in_order(spark):
    ids = random.Random(1).sample(range(-20_000, 20_000), 5000)
    ends = spark.createDataFrame([(1, 2, i) for i in ids] + [(1, 3, 5)], "a long, b long, conv_id long")
    found = {(r["a"], r["b"]): r["ends_sha256"] for r in T.end_digests(ends).collect()}
    assert found == {(1, 2): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), (1, 3): hashlib.sha256(b"5").hexdigest()}


def test_running_over_divided_keys(spark):
    rows = [(k, i, 1 + i % 5, i * 77) for k, n in ((1, 5), (2, 400), (3, 1), (9, 80)) for i in range(n)]
    found = T.running(spark.createDataFrame(rows, "k long, i long, n long, x long").repartition(3), "k", ["i"], {"s": "n"}, {"h": "x"}, "t")
    assert found.columns == ["k", "i", "n", "x", "s", "h", "last"]
    s, h = defaultdict(int), defaultdict(int)
    for r in sorted(found.collect()):
        s[r["k"]] += r["n"]
        h[r["k"]] ^= r["x"]
        assert (r["s"], r["h"]) == (s[r["k"]], h[r["k"]]) and r["last"] == (r["i"] == max(i for k, i, *_ in rows if k == r["k"]))


def test_heads_are_those_of_the_base(spark):
    placed = spark.createDataFrame([(c, p, c, p, 1) for c in (20, 21, 22, 23, 24, 43) for p in range(3)], "conv_id long, place long, x long, y long, words long")
    turns, empty = with_shared_heads(placed)
    for c in (20, 21, 22, 23, 24, 43):
        h = zlib.crc32(str(c).encode()) % 4
        got = [(r["x"], r["y"]) for r in turns.filter(f"conv_id = {c}").orderBy("place").collect()]
        want = ([(20, p) for p in range(h)] if c < 40 else []) + [(c, p) for p in range(h, 3)]
        assert got == want and empty.filter(f"conv_id = {c}").count() == (not want)
