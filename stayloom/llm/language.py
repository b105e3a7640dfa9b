"""Language identification with segmentation-marginalised unigrams.

Every language has probabilities for the pieces of one fixed public vocabulary. The probability of a word is the
sum over all its segmentations into pieces, which a forward pass gives; pieces never span words, so a text's
likelihood is the product over its words. The piece probabilities are fitted by expectation maximisation over the
same segmentations. Forward and backward passes run over many words of one length at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, giving_back, labelled_sample, sample_texts, small_batches

VOCABULARY = "piece_bpe_32k.model"
PER_LANGUAGE = 1500
MAX_CHARS = 1_500_000
MARK = "▁"  # start of a word in the vocabulary
LETTERS = re.compile(r"[^\W\d_]+")
ROUNDS = 4
ADDED = 0.02  # count added to every piece
CACHE = 150_000
BLOCK = 20_000
CELLS = 4_000_000
SLICE_CHARS = 4_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)
LOW = 0.01  # quantile of the log-likelihoods a letter of a language's own documents
LEAST_MARGIN = 0.5  # below that quantile, in nats a letter
DEVIATIONS = 3.0  # allowed to a text for its length


def vocabulary(path: str) -> list[str]:
    """Lower-case letter pieces of a sentencepiece model, with and without the word mark, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        body = piece.removeprefix(MARK)
        if (body == "" or body.isalpha()) and piece == piece.lower() and piece:
            pieces.append(piece)
    return pieces


class Lattice:
    """Finds pieces at every place of many words of one length. Piece 0 stands for a letter outside the vocabulary."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(pieces):
            by_length.setdefault(len(p), []).append((int(self._hash(self.codes([p]))[0]), i + 1))
        self.tables = {}
        for n, found in by_length.items():
            found.sort()
            self.tables[n] = (np.array([h for h, _ in found], dtype=np.uint64), np.array([i for _, i in found]))

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), dtype=np.uint64)
        for j in range(codes.shape[1]):
            h = (h + codes[:, j] + np.uint64(1)) * STEP
            h ^= h >> np.uint64(29)
        return h

    def edges(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(start, end, rows, pieces)``: the words of which this span is a piece. Ends come in order within a start."""
        codes = self.codes(words)
        length = codes.shape[1]
        for start in range(length):
            h = np.zeros(len(codes), dtype=np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                h = (h + codes[:, end - 1] + np.uint64(1)) * STEP
                h ^= h >> np.uint64(29)
                table = self.tables.get(end - start)
                if table is not None:
                    at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
                    rows = np.flatnonzero(table[0][at] == h)
                    piece = table[1][at[rows]]
                else:
                    rows, piece = np.empty(0, int), np.empty(0, int)
                if end == start + 1:
                    every = np.zeros(len(codes), dtype=np.int64)
                    every[rows] = piece
                    rows, piece = np.arange(len(codes)), every
                if len(rows):
                    yield start, end, rows, piece


def by_length(words: list[str], languages: int = 1, cells: int = CELLS) -> Iterator[list[int]]:
    """Indices of words of one length, in blocks of at most BLOCK words and ``cells`` numbers, one for each letter and language, or one word."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    block: list[int] = []
    for i in order:
        most = min(BLOCK, cells // ((len(words[i]) + 1) * max(languages, 1)))
        if block and (len(words[block[0]]) != len(words[i]) or len(block) >= most):
            yield block
            block = []
        block.append(i)
    if block:
        yield block


def log_likelihoods(words: list[str], lattice: Lattice, probability: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations. ``probability``: pieces x languages."""
    out = np.zeros((len(words), probability.shape[1]))
    for block in by_length(words, probability.shape[1]):
        own = [words[i] for i in block]
        length = len(own[0])
        forward = np.zeros((length + 1, len(own), probability.shape[1]))
        forward[0] = 1.0
        shift = np.zeros((len(own), 1))
        done = 0
        for start, end, rows, piece in lattice.edges(own):
            if start > done:  # nothing more ends here: keep numbers in range, for words of any length
                done = start
                if start % 8 == 0:
                    top = forward[start].max(axis=1, keepdims=True)
                    forward[start:start + lattice.longest] /= top
                    shift += np.log(top)
            forward[end, rows] += forward[start, rows] * probability[piece]
        out[block] = np.log(np.maximum(forward[length], 1e-300)) + shift
    return out


def expected_counts(words: list[str], counts: np.ndarray, lattice: Lattice, probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, each word ``counts`` times."""
    total = np.zeros(lattice.size)
    for block in by_length(words):
        own = [words[i] for i in block]
        length, n = len(own[0]), len(own)
        edges = list(lattice.edges(own))
        forward, backward = np.zeros((length + 1, n)), np.zeros((length + 1, n))
        forward[0], backward[length] = 1.0, 1.0
        for start, end, rows, piece in edges:
            forward[end, rows] += forward[start, rows] * probability[piece]
        for start, end, rows, piece in sorted(edges, key=lambda e: -e[0]):
            backward[start, rows] += backward[end, rows] * probability[piece]
        share = counts[block] / np.maximum(forward[length], 1e-300)
        for start, end, rows, piece in edges:
            use = forward[start, rows] * probability[piece] * backward[end, rows] * share[rows]
            total += np.bincount(piece, weights=use, minlength=lattice.size)
    return total


def fit_language(texts: list[str], lattice: Lattice, longest: int = 40) -> tuple[np.ndarray, float]:
    """Piece probabilities of one language and what the added count is of them.

    Letter runs above ``longest`` are scored but not fitted on.
    """
    seen = Counter(w for t in texts for w in words_of(t))
    words = [w for w in seen if len(w) <= longest]
    counts = np.array([seen[w] for w in words], dtype=float)
    probability = np.full(lattice.size, 1.0 / lattice.size)
    for _ in range(ROUNDS):
        uses = expected_counts(words, counts, lattice, probability) + ADDED
        probability = uses / uses.sum()
    return probability, float(ADDED / uses.sum())


def least_fit(texts: list[str], lattice: Lattice) -> tuple[float, float]:
    """``(floor, spread)`` of a language's log-likelihood a letter, from half of its documents under a fit of the others.

    The floor lies below the low quantile by twice the way from there to the median. The spread is the standard
    deviation that one letter adds to a text's sum, so that a text of n letters may miss the floor by some spread / sqrt(n).
    Copies of a text fall on one side. Without documents to judge by the floor is minus infinity.
    """
    side = [zlib.crc32(t.encode("utf-8", "replace")) & 1 for t in texts]
    own = [ws for t, k in zip(texts, side) if k and (ws := words_of(t))]
    if not own:
        return -np.inf, 0.0
    probability = fit_language([t for t, k in zip(texts, side) if not k], lattice)[0]
    words = list(dict.fromkeys(w for ws in own for w in ws))
    found = dict(zip(words, log_likelihoods(words, lattice, probability[:, None])[:, 0]))
    letters = np.array([sum(map(len, ws)) for ws in own])
    rate = np.array([sum(found[w] for w in ws) for ws in own]) / letters
    low, middle = np.quantile(rate, [LOW, 0.5])
    square = sum((found[w] - middle * len(w)) ** 2 for ws in own for w in ws)
    return float(low - max(2 * (middle - low), LEAST_MARGIN)), float(np.sqrt(square / letters.sum()))


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, each with the word mark."""
    found = LETTERS.findall(text.lower())
    if not all(map(str.isalpha, found)):  # numbers such as a raised two are no letters
        found = "".join([c if c.isalpha() else " " for c in " ".join(found)]).split()
    return [MARK + w for w in found]


@dataclass
class Model:
    path: str
    languages: list[str]
    probability: np.ndarray
    floor: np.ndarray  # of each language, least log-likelihood a letter
    spread: np.ndarray  # of each language, standard deviation a letter


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def train(docs: DataFrame, path: str | None = None, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> Model:
    """Fit each language in a task of its own, on at most ``per_language`` documents and ``max_chars`` characters of it.

    Learns from ``text`` and non-null ``lang`` of documents that are not held out; of a repeated id the last
    language in order counts. What comes back to the driver and goes to the executors is one number per language and vocabulary
    piece, some 250 kB a language: the number of languages must be one that fits there. An empty table gives a model without languages.
    """
    path = vocabulary_path(path)
    sample = labelled_sample(docs, "lang", docs, per_language, "lang-sample")
    texts = sample_texts(docs, sample, max_chars, "lang-order")

    def fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lattice = Lattice(vocabulary(path))
        own = sorted(rows["text"])
        probability, added = fit_language(own, lattice)
        floor, spread = least_fit(own, lattice)
        return pd.DataFrame({"label": [key[0]], "probability": [probability], "added": [added], "floor": [floor], "spread": [spread]})

    rows = texts.groupBy("label").applyInPandas(
        fitted, "label string, probability array<double>, added double, floor double, spread double").collect()
    rows.sort(key=lambda r: r["label"])
    if not rows:
        return Model(path, [], np.zeros((1, 0)), np.zeros(0), np.zeros(0))
    probability = np.array([r["probability"] for r in rows]).T.copy()
    # A letter outside the vocabulary that no text had must not speak for the language with the fewest fitted pieces.
    added = np.array([r["added"] for r in rows])
    probability[0] = np.maximum(probability[0] - added, 0.0) + added.min()
    return Model(path, [r["label"] for r in rows], probability, np.array([r["floor"] for r in rows]), np.array([r["spread"] for r in rows]))


class Words:
    """Log-likelihood rows of the words seen so far; forgets all when full."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(vocabulary(model.path))
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.place) > CACHE:
            self.place, self.rows = {}, self.rows[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.rows = np.concatenate([self.rows, log_likelihoods(new, self.lattice, self.model.probability)])
        return self.rows[[self.place[w] for w in words]]


def sums(texts: list[str | None], words: Words) -> Iterator[tuple[np.ndarray, int] | None]:
    """Log-likelihood of each text in each language and its letters, word marks included; None without a letter."""
    own = [words_of(t) if t else [] for t in texts]
    languages = words.model.languages
    flat = words.of([w for ws in own for w in ws]) if languages else np.zeros((sum(map(len, own)), 0))
    at = 0
    for ws in own:
        yield (flat[at:at + len(ws)].sum(axis=0), sum(map(len, ws))) if ws and languages else None
        at += len(ws)


def posterior(z: np.ndarray) -> tuple[int, float]:
    p = np.exp(z - z.max())
    best = int(z.argmax())
    return best, float(p[best] / p.sum())


def identify(texts: list[str | None], words: Words) -> list[tuple[str, float]]:
    """Language and its posterior, all languages alike beforehand, ties to the first in order."""
    out = []
    for found in sums(texts, words):
        if found is None:
            out.append(("und", 0.0))
        else:
            best, p = posterior(found[0])
            out.append((words.model.languages[best], p))
    return out


def judged(texts: list[str | None], given: list[str | None], words: Words) -> list[tuple[str, bool, bool]]:
    """Language, whether the text fits it, and whether it fits the given one."""
    model, out = words.model, []
    place = {name: i for i, name in enumerate(model.languages)}
    for found, name in zip(sums(texts, words), given):
        if found is None:
            out.append(("und", False, False))
            continue
        z, letters = found
        fits = z / letters + DEVIATIONS * model.spread / np.sqrt(letters) >= model.floor
        best, own = int(z.argmax()), place.get(name)
        out.append((model.languages[best], bool(fits[best]), own is not None and bool(fits[own])))
    return out


def sliced(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch in order, some SLICE_CHARS characters of ``text`` at a time."""
    chars = batch["text"].map(lambda t: len(t or "")).to_numpy().cumsum()
    for _, part in batch.groupby((chars - 1).clip(0) // SLICE_CHARS, sort=False):
        yield part


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (its posterior) to documents with ``text``.

    Texts that are null, empty or without a letter, and all texts if no language was learned, give ``und`` and 0.
    Columns of these names are replaced, all others kept.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    @giving_back
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words(shared.value)
        for batch in batches:
            out: list[tuple[str, float]] = []
            part: list[str | None] = []
            chars = 0
            for text in batch:
                part.append(text)
                chars += len(text or "")
                if chars >= SLICE_CHARS:
                    out += identify(part, words)
                    part, chars = [], 0
            out += identify(part, words)
            yield pd.DataFrame(out, columns=["lang_pred", "score"])
            give_back()

    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "__predicted")]
    return docs.withColumn("__predicted", predicted("text")).select(
        *[F.col(f"`{c}`") for c in kept], "__predicted.lang_pred", "__predicted.score")


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred``, ``fits`` and ``lang_fits`` to documents with ``text`` and ``lang``.

    A text fits a language if its log-likelihood a letter reaches that language's floor (see ``least_fit``). The posterior of
    ``predict`` compares learned languages only; this one also tells texts in none of them. Texts without a letter fit none,
    and a ``lang`` that is null or not learned is never fitted.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, fits boolean, lang_fits boolean")
    @giving_back
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        words = Words(shared.value)
        for text, lang in batches:
            out: list[tuple[str, bool, bool]] = []
            for part in sliced(pd.DataFrame({"text": text.to_numpy(), "lang": lang.to_numpy()})):
                out += judged(part["text"].tolist(), part["lang"].tolist(), words)
            yield pd.DataFrame(out, columns=["lang_pred", "fits", "lang_fits"])
            give_back()

    added = ("lang_pred", "fits", "lang_fits")
    kept = [c for c in docs.columns if c not in (*added, "__judged")]
    return docs.withColumn("__judged", found("text", "lang")).select(
        *[F.col(f"`{c}`") for c in kept], *[f"__judged.{c}" for c in added])
