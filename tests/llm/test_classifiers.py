from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs_of  # noqa: F401
from stayloom.llm import language, quality, toxicity
from stayloom.llm.common import held_out, labelled_sample, sample_texts

LARGE = "/root/testdata/sf0.1"


def learned(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


def test_sample_is_bounded_and_free_of_held_out_rows(spark, docs_of):
    docs = docs_of([(i, "x") for i in range(500)] + [(None, "x"), (3, "x")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)] + [(None, 1), (4, None), (8, 1)], "doc_id long, toxic int")
    got = {(r["doc_id"], r["label"]) for r in labelled_sample(labels, "toxic", docs, 30, "s").collect()}
    assert len(got) == 60 and sum(k for _, k in got) == 30 and all(learned(i) and i < 500 for i, _ in got)
    assert got == {tuple(r) for r in labelled_sample(labels.repartition(5), "toxic", docs, 30, "s").collect()}
    marks = {r[0]: r[1] for r in docs.select("doc_id", held_out(F.col("doc_id"))).distinct().collect()}
    assert marks[None] and all(marks[i] == (not learned(i)) for i in range(500))


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{LARGE}/{name}.parquet")
    return read("documents"), read("labels")


def accuracy(scored, labels, label):
    rows = scored.filter(held_out(F.col("doc_id"))).join(labels, "doc_id").select("predicted", label).collect()
    return np.mean([a == b for a, b in rows]), [sum(a != b for a, b in rows if b == k) / sum(b == k for _, b in rows) for k in (0, 1)]


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    right, (false_alarms, misses) = accuracy(toxicity.score(docs, toxicity.train(docs, labels)), labels, "toxic")
    assert right > 0.96 and false_alarms < 0.02 and misses < 0.25


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    right, (bad_kept, good_lost) = accuracy(quality.score(docs, quality.train(docs, labels)), labels, "quality")
    assert right > 0.98 and bad_kept < 0.05 and good_lost < 0.02


def test_language_on_held_out_rows(tables):
    docs, _ = tables
    rows = language.predict(docs, language.train(docs)).filter(held_out(F.col("doc_id"))).select("lang", "lang_pred", "score").collect()
    assert np.mean([r[0] == r[1] for r in rows]) > 0.97 and all(0 <= r[2] <= 1 for r in rows)


def test_noisy_or_and_the_offending_sentence(docs_of):
    model = toxicity.Model({"vile": 6.0}, -4.0)
    text = "All is well here. You vile thing! Nothing more\nEnd"
    got = {r["doc_id"]: r for r in toxicity.score(docs_of([(1, text), (2, ""), (3, None), (4, "123 ... !"), (5, "fine " * 100_000), (5, "fine")]), model).collect()}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    want = 1 - (1 - sigmoid(-4)) ** 3 * (1 - sigmoid(2))
    assert got[1]["score"] == pytest.approx(want) and got[1]["predicted"] == 1
    assert [text[a:b] for a, b in zip(got[1]["starts"], got[1]["stops"])] == [" You vile thing"]
    assert [got[i]["score"] for i in (2, 3, 4)] == [0, 0, 0] and got[5]["predicted"] == 0


def test_noisy_or_learns_sentences_from_document_labels():
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    texts, y = [], []
    for i in range(300):
        s = [" ".join(rng.choices(words, k=8)) for _ in range(6)]
        y.append(i % 3 == 0)
        if y[-1]:
            s[rng.randrange(6)] += " badword"
        texts.append(". ".join(s))
    model = toxicity.fit(texts, np.array(y, dtype=int), np.ones(300))
    weight = toxicity.WordWeights(model)
    _, z = toxicity.sentence_scores("wab wcd. wef badword wgh. wij", weight, model.bias)
    assert int(np.argmax(z)) == 1 and z[1] > 0 > max(z[0], z[2])


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(6, 3, replace=False)) for _ in range(40)]
    y = np.where(rng.random(40) < 0.5, 1, -1)
    scale = np.ones(6)
    w, b = quality.dual_coordinate_descent(rows, scale, y, np.full(40, 0.5), epochs=3000)
    x = np.zeros((40, 7))
    for i, r in enumerate(rows):
        x[i, r], x[i, 6] = 0.5, 0.5

    def loss(v):
        return 0.5 * v @ v + 0.5 * np.maximum(0, 1 - y * (x @ v)).sum()

    best = np.r_[w, b]
    assert all(loss(best) <= loss(best + d) + 1e-4 for d in rng.normal(0, 0.05, (300, 7)))


def test_quality_edges(docs_of, spark):
    model = quality.fit(["good words here and there"] * 20 + ["bad!! bad!! bad!!"] * 20, np.array([1] * 20 + [0] * 20), np.ones(40))
    got = {r["doc_id"]: r for r in quality.score(docs_of([(1, None), (2, ""), (3, "bad!! bad!! bad!!"), (4, "good words"), (5, "x" * 300_000), (4, "good words")]), model).collect()}
    assert got[1]["score"] == got[2]["score"] and got[3]["predicted"] == 0 and got[4]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_empty_tables(docs_of, spark):
    none, labels = docs_of([]), spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert quality.score(none, quality.train(none, labels)).count() == 0
    assert language.predict(none, language.train(none)).count() == 0
    unlearned = docs_of([(1, "words", None, None)])
    assert language.predict(unlearned, language.train(unlearned)).first()["lang_pred"] == "und"
    assert toxicity.score(unlearned, toxicity.train(unlearned, labels)).first()["score"] < 1e-6
    assert 0 <= quality.score(unlearned, quality.train(unlearned, labels)).first()["score"] <= 1


PIECES = ["▁", "a", "b", "▁a", "ab", "ba", "▁ab", "aba", "c"]


def segmentations(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        head = word[:n]
        if head in PIECES or (n == 1 and head not in PIECES):
            for rest in segmentations(word[n:]):
                yield [head, *rest]


def test_forward_pass_sums_all_segmentations():
    lattice = language.Lattice(PIECES)
    p = np.random.default_rng(3).random((lattice.size, 2))
    words = ["▁", "▁a", "▁abab", "▁xaby", "▁abcab", "▁baaba"]
    place = {s: i + 1 for i, s in enumerate(PIECES)}
    got = language.log_likelihoods(words, lattice, p)
    for w, row in zip(words, got):
        for k in (0, 1):
            want = sum(math.prod(p[place.get(s, 0), k] for s in cut) for cut in segmentations(w))
            assert row[k] == pytest.approx(math.log(want))
    counts = language.expected_counts(["▁abab"], np.array([2.0]), lattice, p[:, 0])
    want = np.zeros(lattice.size)
    cuts = [(cut, math.prod(p[place[s], 0] for s in cut)) for cut in segmentations("▁abab")]
    for cut, q in cuts:
        for s in cut:
            want[place[s]] += 2 * q / sum(x for _, x in cuts)
    assert counts == pytest.approx(want)
    long = language.log_likelihoods(["▁" + "ab" * 3000], lattice, p)
    assert np.isfinite(long).all()


def test_language_edges(docs_of):
    rows = [(i, "aa aba ab aa" if i % 2 else "cc bcb cb", "s", "x" if i % 2 else "y") for i in range(60)]
    docs = docs_of([*rows, (100, None), (101, "12 ²³ !?"), (102, ""), (103, "AA Aba"), (104, "cb " * 80_000), (None, "cc"), (103, "AA Aba")])
    got = {r["doc_id"]: r for r in language.predict(docs, language.train(docs)).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103, 104, None)] == ["und", "und", "und", "x", "y", "y"]
    assert got[101]["score"] == 0 and all(got[i]["lang_pred"] == r[3] for i, r in enumerate(rows))


def test_numbers_that_count_as_word_characters_are_no_letters():
    assert language.words_of("²abc ½cup Ⅷ x²y ABC") == ["▁abc", "▁cup", "▁x", "▁y", "▁abc"]
    assert language.words_of("² ½ Ⅷ 12") == []


def test_blocks_of_words_are_bounded_in_letters_and_languages():
    words = ["ab"] * 50 + ["abcd"] * 7 + ["x" * 5000]
    blocks = list(language.by_length(words, languages=2, cells=60))
    assert sorted(i for b in blocks for i in b) == list(range(58))
    assert all(len({len(words[i]) for i in b}) == 1 and (len(b) == 1 or len(b) * (len(words[b[0]]) + 1) * 2 <= 60) for b in blocks)


def test_texts_with_any_letter_have_a_language(docs_of):
    rows = [(i, "aa aba ab aa" if i % 2 else "cc bcb cb", "s", "x" if i % 2 else "y") for i in range(60)]
    docs = docs_of([*rows, (100, "²aba"), (101, "½cc"), (102, "²Ⅷ")])
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, language.train(docs)).collect()}
    assert [got[i] for i in (100, 101, 102)] == ["x", "y", "und"]


def test_a_class_of_long_documents_is_learned(docs_of, spark):
    docs = docs_of([(i, "aa aba ab aa " * (1 if i % 2 else 9000), "s", "x") for i in range(30)]
                   + [(i, "cc bcb cb " * 10_500, "s", "zz") for i in range(100, 140)])
    assert language.train(docs).languages == ["x", "zz"]
    sample = spark.createDataFrame([(i, "zz") for i in range(100, 140)] + [(i, "x") for i in range(30)], "doc_id long, label string")
    chars = {}
    for r in sample_texts(docs, sample, 300_000, "s").collect():
        chars.setdefault(r["label"], []).append(len(r["text"]))
    assert all(sum(c) - max(c) < 300_000 for c in chars.values()) and len(chars["zz"]) == 3
    assert {r["label"] for r in sample_texts(docs, sample, 10, "s").collect()} == {"x", "zz"}


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_labels_leave_the_scores_alone(spark, operator, label):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    docs, labels = read("documents"), read("labels").select("doc_id", label)
    other = labels.withColumn(label, F.when(held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
    strange = other.unionByName(spark.createDataFrame([(-5, 1), (None, 1), (7, None)], f"doc_id long, {label} long").withColumn(label, F.col(label).cast(other.schema[label].dataType)))
    scores = [{r["doc_id"]: r["score"] for r in operator.score(docs, operator.train(docs, x)).collect()} for x in (labels, other, strange)]
    assert scores[0] == scores[1] == scores[2]


def test_held_out_languages_leave_the_predictions_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("other")).otherwise(F.col("lang")))
    found = [sorted(map(tuple, language.predict(docs, language.train(x)).select("doc_id", "lang_pred", "score").collect())) for x in (docs, other)]
    assert found[0] == found[1]
