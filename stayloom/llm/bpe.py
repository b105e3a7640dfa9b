"""BPE encoding and decoding by speculation and verification.

A run of text is first cut greedily into the longest vocabulary entries. Byte-pair merging gives exactly this cut
if every token of it reproduces itself and no merge across two neighbours would come before the merges inside
them; that test depends on the pair alone, so all pairs of many words are tested at once. Only words with a failing
pair are merged step by step.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, giving_back, small_batches

VOCABULARY = "byte_bpe_50k.json"
CACHE = 60_000
LONG_RUN = 1000
SLICE_CHARS = 1_000_000
NEVER = np.iinfo(np.int64).max
# Fixed values of the vocabulary's format: white space, and the pattern that splits text before merging.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable Latin-1 for itself, the rest from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file in which ids follow the order of the merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        letters = byte_letters()
        raw = whole["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        self.vocab = {bytes(letters[c] for c in t): i for t, i in raw.items() if t not in self.special}
        size = 1 + max([*raw.values(), *self.special.values()])
        self.size = size
        self.bytes_of = [b""] * size
        for b, i in self.vocab.items():
            self.bytes_of[i] = b
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.left, self.right = np.full(size, -1, dtype=np.int64), np.full(size, -1, dtype=np.int64)
        self.merges: dict[tuple[int, int], int] = {}
        for pair in whole["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = raw[a], raw[b], raw[a + b]
            self.merges.setdefault((left, right), made)
            if self.left[made] < 0:
                self.left[made], self.right[made] = left, right
        codes = np.array([a * size + b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.made = codes[order], np.array(list(self.merges.values()), dtype=np.int64)[order]
        self.splitter = regex.compile(SPLIT)
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.tree = self._tree()
        self.sound = self._sound()
        self.single = np.array([self.vocab[bytes([b])] for b in range(256)], dtype=np.int64)
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def _tree(self) -> dict:
        root: dict = {}
        for b, i in self.vocab.items():
            node = root
            for x in b:
                node = node.setdefault(x, {})
            node[-1] = i
        return root

    def _sound(self) -> np.ndarray:
        """Whether merging the bytes of a token gives that token."""
        made = np.flatnonzero(self.left >= 0)
        sound = np.ones(self.size, dtype=bool)
        sound[made] = self.compatible(self.left[made], self.right[made], made.copy())
        for t in made:
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        return sound

    def compatible(self, first: np.ndarray, second: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging keeps each pair of tokens apart (or, given ``limit``, joins nothing across before that merge).

        Undoes the latest merge on either side of the border again and again; a merge across the border that comes
        before the one just undone would have happened first.
        """
        fine = np.ones(len(first), dtype=bool)
        at = np.arange(len(first))
        a, b = first.copy(), second.copy()
        limit = np.full(len(first), NEVER) if limit is None else limit
        while len(at):
            code = a * self.size + b
            across = self.lookup(code)
            clash = across < limit
            fine[at[clash]] = False
            can_a, can_b = self.left[a] >= 0, self.left[b] >= 0
            undo_a = can_a & ((a > b) | ~can_b)
            undo_b = can_b & ~undo_a
            go = ~clash & (can_a | can_b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return fine

    def propose(self, word: bytes) -> list[int]:
        """Greedy cut into the longest entries."""
        out, i, n = [], 0, len(word)
        while i < n:
            node, best, end, j = self.tree, -1, i, i
            while j < n:
                node = node.get(word[j])
                if node is None:
                    break
                j += 1
                if -1 in node:
                    best, end = node[-1], j
            out.append(best)
            i = end
        return out

    def lookup(self, code: np.ndarray) -> np.ndarray:
        """Token made by each pair code, or NEVER."""
        spot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[spot] == code, self.made[spot], NEVER)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words together: in each round every word does its earliest merge, leftmost first."""
        out: list[list[int]] = [[]] * len(words)
        for i, w in enumerate(words):
            if len(w) > LONG_RUN:
                out[i] = self._merge_long([self.vocab[w[j:j + 1]] for j in range(len(w))])
        short = [i for i, w in enumerate(words) if len(w) <= LONG_RUN]
        tokens = self.single[np.frombuffer(b"".join([words[i] for i in short]), dtype=np.uint8)]
        owner = np.repeat(np.array(short, dtype=np.int64), [len(words[i]) for i in short])
        best = np.full(len(words), NEVER)
        while len(tokens):
            made = self.lookup(tokens[:-1] * self.size + tokens[1:])
            made[owner[1:] != owner[:-1]] = NEVER
            best[:] = NEVER
            np.minimum.at(best, owner[:-1], made)
            open_words = best[owner] < NEVER
            if not open_words.all():
                at = np.flatnonzero(~open_words)
                edges = np.flatnonzero(np.r_[True, owner[at][1:] != owner[at][:-1]]) if len(at) else at
                for i, part in zip(owner[at][edges], np.split(tokens[at], edges[1:])):
                    out[i] = part.tolist()
                # Words lie together, so the pairs of a word that stays are kept with its first tokens.
                made = np.r_[made, NEVER][open_words][:-1]
                tokens, owner = tokens[open_words], owner[open_words]
            hit = np.flatnonzero(made == best[owner[:-1]]) if len(tokens) else np.empty(0, int)
            # Of overlapping hits, as in a run of one letter, every other one counts.
            run = np.flatnonzero(np.r_[True, np.diff(hit) > 1]) if len(hit) else hit
            hit = hit[(hit - np.repeat(hit[run], np.diff(np.r_[run, len(hit)]))) % 2 == 0]
            tokens[hit] = made[hit]
            keep = np.ones(len(tokens), dtype=bool)
            keep[hit + 1] = False
            tokens, owner = tokens[keep], owner[keep]
        return out

    def _merge_long(self, own: list[int]) -> list[int]:
        """The same with a heap over a linked list, for runs of any length."""
        import heapq

        after, before = list(range(1, len(own) + 1)), list(range(-1, len(own) - 1))
        gone = [False] * len(own)
        heap = [(self.merges[p], i, *p) for i, p in enumerate(zip(own, own[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i] if not gone[i] else len(own)
            if gone[i] or j >= len(own) or own[i] != a or own[j] != b:
                continue
            own[i], gone[j], after[i] = made, True, after[j]
            if after[i] < len(own):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(own) and (own[x], own[y]) in self.merges:
                    heapq.heappush(heap, (self.merges[own[x], own[y]], x, own[x], own[y]))
        return [t for t, g in zip(own, gone) if not g]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of words that splitting never crosses."""
        cuts = [self.propose(w) for w in words]
        flat = np.array([t for c in cuts for t in c], dtype=np.int64)
        owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
        bad = np.zeros(len(cuts), dtype=bool)
        bad[owner[~self.sound[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, place = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        apart = self.compatible(pairs // self.size, pairs % self.size)
        bad[owner[inside[~apart[place]]]] = True
        failed = np.flatnonzero(bad)
        for i, own in zip(failed, self.merge([words[i] for i in failed])):
            cuts[i] = own
        return cuts

    def words(self, text: str) -> list[str]:
        """Pieces that merging never crosses; special strings are pieces of their own."""
        if self.around is None or not self.around.search(text):
            return self.splitter.findall(text)
        out = []
        for k, part in enumerate(self.around.split(text)):
            out += [part] if k % 2 else self.splitter.findall(part)
        return out

    def learn(self, words: set[str]) -> None:
        """Encode words not seen before: number of tokens, ids joined by commas, bytes decoded from the ids."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
        new = [w for w in words if w not in known and w not in self.special]
        for w, ids in zip(new, self.encode_words([w.encode() for w in new]) if new else ()):
            known[w] = (len(ids), ",".join(map(str, ids)), self.decode(ids))
        for w in words & self.special.keys():
            known[w] = (1, str(self.special[w]), self.decode([self.special[w]]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def encode_texts(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, bytes]]]:
        """Per text the entries of its words, of which the text's tokens are the concatenation."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and chars < SLICE_CHARS:
                chars += len(texts[end] or "")
                end += 1
            own = [self.words(t) if t else [] for t in texts[start:end]]
            self.learn(set().union(*own))
            get = self.known.__getitem__
            for ws in own:
                yield list(map(get, ws))
            start = end


@contextmanager
def loaded(path: str) -> Iterator[Bpe]:
    """An encoder for one task. Its tables and known words hold no cycles, so meanwhile cycles are looked for less often."""
    usual = gc.get_threshold()
    gc.set_threshold(200_000, 50, 100)
    try:
        yield Bpe(path)
    finally:
        gc.set_threshold(*usual)


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Add ``ids``, the tokens of ``text`` without added special tokens, and ``round_trip``, whether decoding them gives the text.

    Special strings in a text become their ids. Null and empty texts have no tokens, which decode to an empty text.
    Columns of these names are replaced, all others kept.
    """
    path = vocabulary_path(path)
    small_batches(docs.sparkSession)

    @F.pandas_udf("ids array<int>, round_trip boolean")
    @giving_back
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with loaded(path) as bpe:
            for batch in batches:
                texts, ids, same = batch.tolist(), [], []
                for text, entries in zip(texts, bpe.encode_texts(texts)):
                    ids.append(np.fromstring(",".join([e[1] for e in entries]), dtype=np.int32, sep=","))
                    same.append(b"".join([e[2] for e in entries]) == (text or "").encode())
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "round_trip": pd.Series(same, dtype=bool)})
                texts, ids, same = [], [], []
                give_back()

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "round_trip", "__encoded")]
    return docs.withColumn("__encoded", encoded("text")).select(*kept, "__encoded.ids", "__encoded.round_trip")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Add ``decoded``, the text of ``ids``, special tokens as their strings. Null ids give an empty text.

    Bytes that are no UTF-8 become U+FFFD; ids outside the vocabulary are an error.
    """
    path = vocabulary_path(path)

    small_batches(encoded.sparkSession)

    @F.pandas_udf("string")
    @giving_back
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with loaded(path) as bpe:
            for batch in batches:
                yield pd.Series([bpe.decode([] if ids is None else list(ids)).decode("utf-8", "replace") for ids in batch], dtype=object)

    kept = [F.col(f"`{c}`") for c in encoded.columns if c != "decoded"]
    return encoded.select(*kept, decoded("ids").alias("decoded"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Add ``n_tokens, ids_sha256, decoded_sha256``: digests of the ids joined by commas and of the text decoded from them.

    Null and empty texts have no tokens and the digests of an empty string. Columns of these names are replaced, all others kept;
    rows are judged one by one, and an empty table gives an empty one.
    """
    path = vocabulary_path(path)
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    @giving_back
    def digested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with loaded(path) as bpe:
            for batch in batches:
                out = []
                for entries in bpe.encode_texts(batch.tolist()):
                    ids = ",".join([e[1] for e in entries])
                    text = b"".join([e[2] for e in entries]).decode("utf-8", "replace")
                    out.append((sum([e[0] for e in entries]), hashlib.sha256(ids.encode()).hexdigest(),
                                hashlib.sha256(text.encode()).hexdigest()))
                yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    added = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in added and c != "__digest"]
    return docs.withColumn("__digest", digested("text")).select(*kept, *[f"__digest.{c}" for c in added])
