from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    now = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [now.collect()]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, now, FOLDER).write.parquet(path)
        now = spark.read.parquet(path)
        out.append(now.collect())
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "mixture", "tokens"]
    for rows in steps[:-1]:
        assert sorted(rows[0].__fields__) == sorted(pipeline.COLUMNS)


def test_toxicity_removes_what_the_labels_name(spark, steps):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {r["doc_id"] for r in steps[1]}
    clean, bad = [i for i, k in toxic.items() if k == 0], [i for i, k in toxic.items() if k == 1]
    assert sum(i in left for i in clean) >= 0.97 * len(clean) and sum(i in left for i in bad) <= 0.3 * len(bad)


def test_language_keeps_texts_with_letters(steps):
    assert {r["doc_id"] for r in steps[1] if any(c.isalpha() for c in r["text"])} == {r["doc_id"] for r in steps[2]}


def test_one_of_each_group_stays(steps):
    from test_minhash import brute

    names = brute([(r["doc_id"], r["text"]) for r in steps[2]], 5)
    assert sorted(r["doc_id"] for r in steps[3]) == sorted(set(names.values()))


def test_mixture_repeats_documents(steps):
    size = {r["doc_id"]: len(r["text"].split()) for r in steps[3]}
    copies = {i: 0 for i in size}
    for r in steps[4]:
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 2
    assert sum(size[i] * n for i, n in copies.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.02)


def test_tokens_are_those_of_the_library(steps):
    texts = {r["doc_id"]: r["text"] for r in steps[4]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(steps[5]) == len(steps[4])
    for r in steps[5][:200]:
        assert r["round_trip"] and r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_stages_bear_nulls_and_empty_tables(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (2, "Some plain words", "en", None, 16), (2, "Some plain words", "en", None, 16)], schema)
    for docs in (odd, odd.limit(0)):
        for _, stage in pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema) if stage is not pipeline.tokenize else stage(spark, docs, FOLDER)
        docs.collect()


def test_stages_drop_other_columns_even_if_they_clash(spark):
    """Columns named like those that stages add are not mistaken for them; a stage returns the columns of documents."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 300")
    odd = docs.withColumns({c: F.lit(-1) for c in ("score", "predicted", "lang_pred", "fits", "kept", "size", "copies", "ids", "draw", "label")})
    for name, stage in pipeline.STAGES:
        plain, clashing = (stage(spark, x, FOLDER) for x in (docs, odd))
        assert clashing.columns == plain.columns and (name == "tokens" or clashing.columns == pipeline.COLUMNS)
        assert sorted(map(str, clashing.collect())) == sorted(map(str, plain.collect()))


def test_language_rejects_what_was_not_learned(spark):
    """Planted texts beside clean rows: an unlearned script, unlearned languages, gibberish, a wrong and a missing lang."""
    import random

    r = random.Random(3)
    gibberish = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 10))) for _ in range(n)) for n in (8, 60, 400)]
    foreign = ["\u0395\u03bb\u03bb\u03b7\u03bd\u03b9\u03ba\u03cc \u03ba\u03b5\u03af\u03bc\u03b5\u03bd\u03bf " * 20, "\u10e5\u10d0\u10e0\u10d7\u10e3\u10da\u10d8 \u10e2\u10d4\u10e5\u10e1\u10e2\u10d8 " * 20,
               "To jest zwyk\u0142y tekst po polsku, kt\u00f3rego nikt si\u0119 nie uczy\u0142. "]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(*pipeline.COLUMNS)
    clean = [tuple(x) for x in docs.collect()]
    german = max((x for x in clean if x[2] == "de" and len(x[1]) < 3000), key=lambda x: len(x[1]))
    bad = [(None, t, ["en", None][i % 2], "a", len(t)) for i, t in enumerate(gibberish + foreign)]
    # Ids that are held out, so that the planted rows are not learned from.
    import zlib
    ids = (i for i in range(10**9, 10**9 + 1000) if zlib.crc32(str(i).encode()) % 5 == 0)
    bad = [(next(ids), *row[1:]) for row in bad]
    mended = [(next(ids), german[1], lang, "a", 1) for lang in ("en", None, "xx")]
    got = {x["doc_id"]: x["lang"] for x in pipeline.keep_languages(spark, spark.createDataFrame(clean + bad + mended, docs.schema), FOLDER).collect()}
    assert not {x[0] for x in bad} & set(got)
    assert [got[x[0]] for x in mended] == ["de"] * 3
    assert all(x[0] in got for x in clean if any(c.isalpha() for c in x[1]))
    # Each language in turn is one that was not learned.
    for lang in ("fr", "es"):
        left = docs.withColumn("lang", F.when(F.col("lang") != lang, F.col("lang")))
        stay = {x["doc_id"] for x in pipeline.keep_languages(spark, left, FOLDER).collect()}
        long = [x for x in clean if len(x[1]) > 100]
        assert sum(x[0] in stay for x in long if x[2] == lang) <= 0.02 * sum(x[2] == lang for x in long)
        assert all(x[0] in stay for x in long if x[2] != lang)


def test_workers_keep_nothing_after_the_last_batch():
    """What a finished task holds in cycles goes with it, not at some later collection of an idle worker."""
    import gc
    import weakref

    from stayloom.llm.common import giving_back

    class Table:
        pass

    held = []

    @giving_back
    def work(batches):
        table = Table()
        table.own = table
        held.append(weakref.ref(table))
        yield from batches

    usual = gc.isenabled()
    gc.disable()
    try:
        assert list(work(iter([1, 2]))) == [1, 2]
        assert held[0]() is None
    finally:
        if usual:
            gc.enable()
