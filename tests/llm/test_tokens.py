from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_fixtures import docs_of  # noqa: F401
from stayloom.llm import bpe, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["the", "in", "er", "an", "tion", " ", "  ", "\n", "\t", "Th", "'s", "don't", "12", "é", "日本", "<|endoftext|>", "<|startoftext|>",
         "\x1c", "\x85", " ", "　", "́", "!", "$$$", "😀", "ſ", "İ", "Σ"]


def odd(n, seed, longest=40):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, longest))) for _ in range(n)] + [
        "", " ", "a" * 3000, "ab" * 700, " a", "a ", "\n\n a\n", "x<|endoftext|>", None, "日本語" * 400]


def test_encoding_equals_the_library():
    own, library = bpe.Bpe(BYTE), Tokenizer.from_file(BYTE)
    texts = odd(1500, 1)
    for text, entries in zip(texts, own.encode_texts(texts)):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ",".join(e[1] for e in entries) == ",".join(map(str, want))
        assert b"".join(e[2] for e in entries).decode() == library.decode(want, skip_special_tokens=False)


def test_pairs_are_apart_exactly_if_merging_keeps_them():
    own = bpe.Bpe(BYTE)
    r = random.Random(4)
    pairs = [(r.randrange(50000), r.randrange(50000)) for _ in range(3000)] + [(own.vocab[b"t"], own.vocab[b"he"])]
    import numpy as np

    a, b = (np.array(x) for x in zip(*pairs))
    merged = own.merge([own.bytes_of[x] + own.bytes_of[y] for x, y in pairs])
    assert own.compatible(a, b).tolist() == [m == [x, y] for m, (x, y) in zip(merged, pairs)]
    run = b"abababab" * 400
    assert own._merge_long([own.vocab[run[i:i + 1]] for i in range(len(run))]) == Tokenizer.from_file(BYTE).encode(run.decode(), add_special_tokens=False).ids


def test_encode_decode_and_digests(docs_of):
    texts = odd(60, 2)
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])])
    coded = bpe.decode(bpe.encode(docs.withColumnRenamed("score", "ids")))
    library = Tokenizer.from_file(BYTE)
    for r in coded.collect():
        assert r["decoded"] == (r["text"] or "") and r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
    for r in bpe.digests(docs.withColumnRenamed("score", "n_tokens")).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == bpe.encode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(40, 24, 6), (200, 90, 10), (32_768, 16_384, 256)])
def test_token_counts_equal_the_library(sizes):
    own = tokens.Counter(WORD, *sizes)
    texts = odd(1200, 3, 120)
    for text, n in zip(texts, own.counts(texts)):
        assert n == len(own.tokenizer.encode(text or "", add_special_tokens=False).ids)
    assert own.widened > 0 or sizes[0] > 1000


def test_huge_documents_are_spliced():
    own = tokens.Counter(WORD)
    r = random.Random(9)
    for glue in (" ", "\n", ""):
        text = glue.join(r.choice(PARTS + ["word", "Other,"]) for _ in range(30_000))
        assert own.huge_count(text) == len(own.tokenizer.encode(text, add_special_tokens=False).ids)


def test_count_tokens_on_tables(docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "é word"), (4, "word " * 3000), (4, "word " * 3000)]).withColumnRenamed("score", "n_bytes")
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(docs).collect())
    assert got == [(1, 0, 0, False), (2, 0, 0, False), (3, 7, 2, False), (4, 15000, 3000, True), (4, 15000, 3000, True)]
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_most_bytes_in_huge_texts(spark, docs_of):
    """Documents joined to texts of a megabyte, which all go by overlapping chunks, beside small ones."""
    own = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").limit(1500).collect() if r["text"]]
    whole = "\n".join(own)
    huge = [whole[k:k + 1_000_000] for k in range(0, min(len(whole), 3_000_000), 1_000_000)] + ["x" * 400_000, ("wort" * 200 + " ") * 600]
    rows = [(i, t) for i, t in enumerate(huge + own[:50])]
    assert sum(len(t) for t in huge) > 10 * sum(len(t) for t in own[:50]) and all(len(t) > tokens.HUGE for t in huge)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs_of(rows)).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}
