"""Token counts with overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets. Two chunks are spliced where both have a token border
after the same white space: this vocabulary's normaliser and splitter never join anything across white space, so
from such a border on every encoding agrees with that of the whole text, and the tokens up to the next border are
compared as well. If the overlap has no such border it is widened until it has, or until the text ends. Other
texts are cut at all their white space, by the same rule, and each different word is encoded once per worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOCABULARY = "word_bpe_49k.json"
HUGE = 32_768
CHUNK = 16_384
OVERLAP = 256
CACHE = 300_000
SLICE_CHARS = 4_000_000
# The white space of the normaliser's pattern.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f"[^{WHITE}]+")
BORDER = re.compile(f"(?<=[{WHITE}])[^{WHITE}]")
ODD = re.compile("[\x1c-\x1f]")  # str.split() takes these for white space, the vocabulary does not


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if ODD.search(text) else text.split()


class Counter:
    """Counts tokens as one tokenizers file does, without added special tokens."""

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.known: dict[str, int] = {}
        self.widened = 0

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and where each token starts."""
        got = self.tokenizer.encode(text, add_special_tokens=False)
        return got.ids, [o[0] for o in got.offsets]

    def huge_count(self, text: str) -> int:
        """Tokens of a huge text: ``at`` is the border from which the present chunk counts."""
        total, at = 0, 0
        ids, starts = self.encode(text[:self.chunk])
        stop = min(self.chunk, len(text))
        while stop < len(text):
            overlap = self.overlap
            while True:
                begin = max(at, stop - overlap)
                right_ids, right_starts = self.encode(text[begin:begin + self.chunk + overlap])
                border = self.splice(text, at, stop, begin, (ids, starts), (right_ids, right_starts))
                if border is not None or begin == at:
                    break
                overlap *= 2
                self.widened += 1
            if border is None:
                # No border in the whole chunk: encode it together with the text that follows.
                self.widened += 1
                stop = min(len(text), stop + max(self.chunk, stop - at))
                ids, starts = self.encode(text[at:stop])
                continue
            total += sum(s < border - at for s in starts)
            ids = [i for i, s in zip(right_ids, right_starts) if s >= border - begin]
            starts = [s - (border - begin) for s in right_starts if s >= border - begin]
            at, stop = border, min(len(text), begin + self.chunk + overlap)
        return total + len(ids)

    def splice(self, text: str, at: int, stop: int, begin: int, left: tuple, right: tuple) -> int | None:
        """First border in the overlap at which both chunks have the same tokens up to the next border."""
        borders = [m.start() for m in BORDER.finditer(text, begin, stop)]
        for here, after in zip(borders, borders[1:]):
            if here <= at:
                continue
            own = [[i for i, s in zip(ids, starts) if here <= s + shift < after]
                   for (ids, starts), shift in ((left, at), (right, begin))]
            if own[0] and own[0] == own[1]:
                return here
        return None

    def counts(self, texts: list[str | None]) -> Iterator[int]:
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and chars < SLICE_CHARS:
                chars += len(texts[end] or "")
                end += 1
            own = [None if t and len(t) > self.huge else words_of(t) if t else [] for t in texts[start:end]]
            if len(self.known) > CACHE:
                self.known.clear()
            new = list({w for ws in own if ws for w in ws if w not in self.known})
            got = self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else []
            self.known.update(zip(new, map(len, got)))
            get = self.known.__getitem__
            for ws, text in zip(own, texts[start:end]):
                yield self.huge_count(text) if ws is None else sum(map(get, ws))
            start = end


_LOADED: dict[str, Counter] = {}


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """Add ``n_bytes, n_tokens, over_limit`` to documents with ``text``; a null text counts as empty.

    Columns of these names are replaced, all others kept; rows are judged one by one, and an empty table gives an empty one.
    """
    path = vocabulary_path(path)
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _LOADED:
            _LOADED[path] = Counter(path)
        for batch in batches:
            yield pd.Series(list(_LOADED[path].counts(batch.tolist())), dtype="int64")

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    return docs.select(
        *kept, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), counted("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
