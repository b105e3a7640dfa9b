"""Toxicity by multiple-instance learning.

Only documents carry labels. A sentence gets a logistic score from its words and their beginnings; a document is
toxic if any sentence is, so its score is the noisy-or ``1 - prod(1 - p)`` over its sentences, and the gradient of
the document's loss trains the sentence scores. Those then say which sentences offend. Only features that are
surely commoner in toxic documents take part.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_sizes, giving_back, labelled_sample, sample_texts, small_batches

PER_CLASS = 2500
MAX_CHARS = 5_000_000
LEAST = 3  # different sentences
SURE = 3.0
STARTS = (4, 5, 6)
SENTENCE = re.compile(r"[^.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")
CACHE = 200_000


def parts(word: str) -> list[str]:
    """Features of a word: itself and, marked with a hyphen, its first letters."""
    return [word, *[word[:n] + "-" for n in STARTS if len(word) >= n]]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float


class WordWeights(dict):
    """Sum of the weights of a word's features, computed once for each word."""

    def __init__(self, model: Model):
        self.weights = model.weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = sum(self.weights.get(p, 0.0) for p in parts(word))
        return value


def telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log ratio of shares of different sentences for features that are surely commoner in those of toxic documents.

    The ratio must exceed ``SURE`` times its standard error, which leaves out what a few sentences share by chance.
    Zero for all other features.
    """
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    sure = (toxic >= LEAST) & (ratio > SURE * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))
    return np.where(sure, ratio, 0.0)


def fit(texts: list[str], labels: np.ndarray, importance: np.ndarray, steps: int = 120, rate: float = 0.1,
        l2: float = 1e-4) -> Model:
    """Full-batch Adam on the noisy-or log loss, from weights at half the features' log ratios.

    ``importance`` weighs documents, so a class cut in the sample keeps its share.
    """
    y = labels.astype(float)
    number: dict[str, int] = {}
    tokens, sizes, owners, fresh = array("i"), [], [], []
    met: set[tuple[int, int]] = set()
    for d, text in enumerate(texts):
        for s in SENTENCE.findall(text):
            own = [number.setdefault(p, len(number)) for w in LETTERS.findall(s.lower()) for p in parts(w)]
            if own:
                tokens.extend(own)
                sizes.append(len(own))
                owners.append(d)
                key = (int(labels[d]), hash(tuple(own)))
                fresh.append(key not in met)  # copies of a document count once
                met.add(key)
    flat, owner_of, first_time = np.array(tokens, dtype=np.int64), np.array(owners, dtype=np.int64), np.array(fresh, dtype=bool)
    sentence = np.repeat(np.arange(len(sizes)), sizes)

    def counted(k: int) -> tuple[np.ndarray, int]:
        own = first_time & (labels[owner_of] == k)
        at = own[sentence]
        pairs = np.unique(sentence[at] * len(number) + flat[at])
        return np.bincount(pairs % max(len(number), 1), minlength=len(number)), int(own.sum())

    (toxic, n_toxic), (clean, n_clean) = counted(1), counted(0)
    ratio = telling(toxic, clean, n_toxic, n_clean)
    kept = np.flatnonzero(ratio)
    names = [p for p, i in number.items() if ratio[i]]  # in the order of their numbers, like kept
    place = {p: i for i, p in enumerate(names)}
    inside = ratio[flat] > 0
    sentence, flat = sentence[inside], np.searchsorted(kept, flat[inside])
    n, size = len(texts), len(place)
    share = importance / importance.sum()
    first = ratio[kept] / 2
    w, b = first.copy(), -6.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(sentence, weights=w[flat], minlength=len(sizes)) + b
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        none = np.exp(-np.bincount(owner_of, weights=np.logaddexp(0.0, z), minlength=n))
        pull = np.where(y > 0, -none / np.maximum(1.0 - none, 1e-9), 1.0) * share
        g = p * pull[owner_of]
        gw = np.bincount(flat, weights=g[sentence], minlength=size) + l2 * (w - first)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        up, down = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / up) / (np.sqrt(v / down) + 1e-8)
        b -= rate * (mb / up) / (np.sqrt(vb / down) + 1e-8)
    return Model({k: float(w[i]) for k, i in place.items()}, float(b))


def sentence_scores(text: str, weight: WordWeights, bias: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spans and logits of the sentences that hold a letter."""
    spans, logits = [], []
    for m in SENTENCE.finditer(text):
        found = LETTERS.findall(m[0].lower())
        if found:
            spans.append(m.span())
            logits.append(sum(map(weight.__getitem__, found)))
    return spans, np.array(logits) + bias


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS,
          max_chars: int = MAX_CHARS) -> Model:
    """Fit on at most ``per_class`` documents of each class, and no more once they reach ``max_chars`` characters.

    Held-out ids count nowhere, neither in the sample nor in the classes' shares. Of a repeated id the largest label counts; labels
    without a document or without value, and null texts, do not. Without anything to learn from the model scores all texts alike.
    """
    sample = labelled_sample(labels, label, docs, per_class, "toxic-sample")
    rows = sample_texts(docs, sample, max_chars, "toxic-order").toPandas()
    shares = class_sizes(labels, label, docs)
    if rows.empty:
        return Model({}, -40.0)
    y = (rows["label"].to_numpy() == 1).astype(int)
    taken = rows["label"].value_counts()
    importance = rows["label"].map(lambda k: shares[k] / taken[k]).to_numpy(dtype=float)
    return fit(rows["text"].tolist(), y, importance)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Add ``score, predicted, starts, stops`` to documents with ``text``.

    ``starts`` and ``stops`` are the character spans of the offending sentences: those that score at least
    ``threshold`` themselves, or in a document that reaches it only in sum, the highest one. Texts that are null,
    empty or without letters have no sentence and score 0. Columns of these names are replaced, all others kept.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, starts array<int>, stops array<int>")
    @giving_back
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weight, bias = WordWeights(shared.value), shared.value.bias
        for batch in batches:
            out = []
            for text in batch:
                spans, z = sentence_scores(text, weight, bias) if text else ([], np.empty(0))
                if not spans:
                    out.append((0.0, [], []))
                    continue
                total = float(-np.expm1(-np.logaddexp(0.0, z).sum()))
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
                hits = np.flatnonzero(p >= threshold)
                if total >= threshold and not len(hits):
                    hits = np.array([int(p.argmax())])
                out.append((total, [spans[i][0] for i in hits], [spans[i][1] for i in hits]))
            yield pd.DataFrame(out, columns=["score", "starts", "stops"])

    added = ["score", "predicted", "starts", "stops"]
    kept = [c for c in docs.columns if c not in added and c != "__scored"]
    return docs.withColumn("__scored", scored("text")).select(
        *[F.col(f"`{c}`") for c in kept], "__scored.score",
        (F.col("__scored.score") >= threshold).cast("int").alias("predicted"), "__scored.starts", "__scored.stops")
