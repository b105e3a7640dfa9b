from __future__ import annotations

import itertools
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import docs_of  # noqa: F401
from stayloom.llm import pii
from stayloom.llm.queries_pii import QUERIES

SMALL = "/root/testdata/sf0.01"
# The rules as the contract states them.
RULES = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == 2:
        return all(int(p) <= 255 for p in span.split("."))
    if kind == 3:
        doubled = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(x // 10 + x % 10 for x in doubled) % 10 == 0
    return kind == 1 or 9 <= len(digits) <= 15


def ruled(text):
    return sorted(((k, *m.span()) for k, rule in enumerate(RULES, 1) for m in rule.finditer(text) if passes(k, m[0])),
                  key=lambda s: (s[1], s[0]))


pieces = st.lists(st.sampled_from(
    ["@", ".", "a", "B-", "%", "1", "22", "255", "256", " ", "-", "+", "(", ")", "4111111111111111", "555", "é", "0", "\n", "x.de", "1.2.3.4", "²", "٣"]), max_size=40)


@settings(max_examples=1500, deadline=None)
@given(pieces)
def test_rules_are_those_of_the_contract(parts):
    text = "".join(parts)
    assert pii.base_spans(text)[0] == ruled(text)


def segmentations(ends):
    """All ways from the first to the last boundary: segments with kind and features."""
    paths = {0: [[]]}
    for j in range(1, len(ends)):
        paths[j] = [[*p, (i, j, k, f)] for i, k, f in ends[j] for p in paths[i]]
    return paths[len(ends) - 1]


def total(path, weight):
    score, before = 0.0, 0
    for _, _, k, f in path:
        score += sum(weight.get(x, 0.0) for x in f) + weight.get(("t", before, k), 0.0)
        before = k
    return score


@pytest.mark.parametrize("text", [
    "t +1 (269) 555-3296 4524132264652876 x", "9 10.20.30.40 4111 1111 1111 1111", "a.b@c.de, +49 30 1234567.", "(030) 12 34 56-78"])
def test_dynamic_programming_equals_all_segmentations(text):
    r = random.Random(len(text))
    seen = 0
    for own in pii.zones(pii.candidates(text)):
        bounds, ends = pii.lattice(text, own)
        names = {x for e in ends for *_, f in e for x in f} | {("t", p, k) for p in range(5) for k in range(5)}
        weight = {x: r.uniform(-1, 1) for x in sorted(names, key=str)}
        paths = segmentations(ends)
        scores = [total(p, weight) for p in paths]
        z, expected = pii.expectations(ends, weight)
        assert z == pytest.approx(math.log(sum(map(math.exp, scores))))
        shares = [math.exp(s - z) for s in scores]
        for x in names:
            plain = sum(w * sum(f.count(x) for *_, f in p) for w, p in zip(shares, paths))
            if x[0] != "t":
                assert expected.get(x, 0.0) == pytest.approx(plain, abs=1e-9)
        best = max(paths, key=lambda p: total(p, weight))
        assert pii.best_path(ends, weight) == [(k, i, j) for i, j, k, _ in best if k]
        assert bounds == sorted(bounds)
        seen += len(paths)
    assert seen > 4


def number(r, n=16):
    digits = str(r.randrange(1, 10)) + "".join(str(r.randrange(10)) for _ in range(n - 2))
    return next(digits + c for c in "0123456789" if pii.luhn(digits + c))


def invented(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randrange(2, 9)))
    makers = [
        lambda: f"{word()}.{r.randrange(99)}@{word()}.org", lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda: number(r),
        lambda: f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", lambda: f"token={r.randrange(16**16):016x}",
        lambda: str(r.randrange(10**9))]
    out = []
    for _ in range(n):
        picked = [-1 if r.random() < 0.7 else r.randrange(len(makers)) for _ in range(60)]
        parts = [word() if k < 0 else makers[k]() for k in picked]
        out.append((" ".join(parts), {p for p, k in zip(parts, picked) if 0 <= k < 4}))
    return out


@pytest.fixture(scope="module")
def model():
    examples = [(e["text"], [tuple(g) for g in pii.json.loads(e["gold"])]) for t, _ in invented(1, 120) for e in pii.examples_of(t)]
    return pii.fit(examples + list(pii.broken(examples)))


def found(text, model):
    base = pii.base_spans(text)[0]
    return [(pii.KINDS[k - 1], text[s:e]) for k, s, e in pii.added_spans(text, base, model)]


def test_model_takes_apart_what_the_rules_drop(model):
    r = random.Random(9)
    for _ in range(40):
        card, phone = number(r), f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"
        text = f"wort {phone} {card} wort"
        assert ruled(text) == [] and found(text, model) == [("phone", phone), ("card", card)]


def test_model_leaves_plain_texts_alone(model):
    extra = [(x, x[1] in true) for t, true in invented(77, 100) for x in found(t, model)]
    assert len(extra) > 100 and sum(right for _, right in extra) > 0.98 * len(extra)
    for text in ("order 4524132264652877 y", "2024-01-02 10:20:30", "1234567", 'id "8b7b7ebadd0a6c91de764263600241f1767a83f0"', "3.14 2.71 1.41"):
        assert found(text, model) == []


def test_query_on_a_table(spark):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_personal_data"](spark, SMALL).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        base = ruled(docs[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(1 for b in base if b[0] == i) for i in (1, 2, 3, 4)]
        listed = [f"{pii.KINDS[k - 1]}:{s}:{e}" for k, s, e in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(listed) <= set(spans) and len(spans) == len(listed) + r["n_added"]
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))


def test_edges(spark, docs_of, model):  # noqa: F811
    rows = [(1, None), (2, ""), (3, "kein Fund"), (4, "é @ 😀 a@b.de"), (4, "é @ 😀 a@b.de"), (None, "+49 30 1234567"), (6, "1" * 300_000 + "@" * 5000),
            (7, "1 " * 100_000), (8, "a" * 500_000 + "@b")]
    docs = docs_of(rows).withColumnRenamed("source", "spans")
    spans = sorted((r["doc_id"] or 0, [tuple(s) for s in r["spans"]]) for r in pii.find(docs, model).collect())
    assert spans[:6] == [(0, [("phone", 0, 14, True)]), (1, []), (2, []), (3, []), (4, [("email", 6, 12, True)]), (4, [("email", 6, 12, True)])]
    assert all(not any(s[3] for s in own) for _, own in spans[6:])
    assert pii.find(docs.limit(0), {}).count() == 0 and pii.train(docs.limit(0)) == {}
    assert pii.find(docs, {}).columns == ["doc_id", "text", "lang", "n_chars", "score", "spans"]


def test_overlapping_base_spans_all_stay(model):
    text = "x +49.30.12.34 y 4111111111111111@a.de"
    base = pii.base_spans(text)[0]
    assert base == ruled(text) and len(base) >= 2
    assert all(e <= s or f >= g for _, s, g in pii.added_spans(text, base, model) for _, f, e in base)
