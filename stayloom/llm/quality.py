"""Quality by naive Bayes support vectors.

A text becomes indicators of n-grams: of its words, and of the forms of its tokens (lower case, capitalised, all
capitals, repeated, digits, the marks themselves). Each indicator is scaled by the log ratio of its counts in the
two classes, and a linear model with hinge loss is fitted to the scaled indicators by dual coordinate descent. A
logistic curve fitted to held-back folds turns margins into probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_sizes, giving_back, labelled_sample, sample_texts, small_batches

PER_CLASS = 2500
MAX_CHARS = 5_000_000
MIN_DOCS = 10
LONGEST = 3
TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]+|_+")
CACHE = 200_000
FOLDS = 4


class Forms(dict):
    """Form of a token, found once for each: ``a`` lower case, ``A`` capitalised, ``U`` capitals, ``m`` mixed, ``0`` digits."""

    def __missing__(self, token: str) -> str:
        if len(self) >= CACHE:
            self.clear()
        first = token[0]
        if first.isalpha():
            form = ("a" if token.islower() else "U" if len(token) > 1 and token.isupper()
                    else "A" if token[1:].islower() or len(token) == 1 else "m")
        elif first.isdigit():
            form = "0"
        else:
            form = token[:3]
        self[token] = form
        return form


def ngrams(text: str, forms: Forms) -> set:
    """Indicators: words in lower case, and n-grams of forms as tuples; a word equal to the one before has form ``=``."""
    tokens = TOKEN.findall(text)
    shape = [forms[t] for t in tokens]
    shape = ["=" if a == b and a[0].isalpha() else s for a, b, s in zip(tokens, [" ", *tokens], shape)]
    found = set(map(str.lower, tokens))
    for n in range(1, LONGEST + 1):
        found.update(zip(*[shape[i:] for i in range(n)]))
    return found


@dataclass
class Model:
    weights: dict
    bias: float
    slope: float
    shift: float


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray,
                            epochs: int = 20, seed: int = 5) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model over unit-length rows of scaled indicators; ``cost`` bounds each dual variable."""
    values = []
    for r in rows:
        v = scale[r]
        values.append(v / max(float(np.sqrt(v @ v + 1.0)), 1e-12))
    bias_values = [1.0 / max(float(np.sqrt(scale[r] @ scale[r] + 1.0)), 1e-12) for r in rows]
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in random.permutation(len(rows)):
            r, v, bv = rows[i], values[i], bias_values[i]
            g = y[i] * (w[r] @ v + b * bv) - 1.0
            if (alpha[i] == 0 and g >= 0) or (alpha[i] == cost[i] and g <= 0):
                continue
            new = min(max(alpha[i] - g, 0.0), cost[i])  # the row's length is 1
            step = (new - alpha[i]) * y[i]
            largest = max(largest, abs(step))
            w[r] += step * v
            b += step * bv
            alpha[i] = new
        if largest < 1e-3:
            break
    return w, b


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    counts = [np.bincount(np.concatenate([r for r, k in zip(rows, y) if k == c] or [np.empty(0, int)]), minlength=size)
              + 1.0 for c in (1, -1)]
    return np.log(counts[0] / (y == 1).sum()) - np.log(counts[1] / (y == -1).sum())


def margins(rows: list[np.ndarray], scale: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    return np.array([(w[r] @ scale[r] + b) / np.sqrt(scale[r] @ scale[r] + 1.0) for r in rows])


def logistic_curve(z: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of P(1) = 1 / (1 + exp(-(slope z + shift))) by Newton steps."""
    x = np.stack([z, np.ones_like(z)], 1)
    theta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-6 * theta
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        theta -= np.linalg.solve(hessian, gradient)
    return float(theta[0]), float(theta[1])


def fit(texts: list[str], labels: np.ndarray, importance: np.ndarray, cost: float = 1.0) -> Model:
    """Naive Bayes ratios, hinge-loss weights and the probability curve. ``importance`` restores the classes' shares."""
    forms = Forms()
    sets = [ngrams(t, forms) for t in texts]
    seen = Counter(g for s in sets for g in s)
    place = {g: i for i, g in enumerate(sorted((g for g, n in seen.items() if n >= MIN_DOCS), key=str))}
    rows = [np.array(sorted(place[g] for g in s if g in place), dtype=np.int64) for s in sets]
    y = np.where(labels == 1, 1, -1)
    if len(set(y)) < 2:
        return Model({}, 0.0, 0.0, 4.0 if (y == 1).all() else -4.0)
    bounds = np.full(len(y), cost)

    def solve(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        own = [rows[i] for i in at]
        ratio = log_count_ratio(own, y[at], len(place))
        return ratio, *dual_coordinate_descent(own, ratio, y[at], bounds[at])

    fold = np.random.default_rng(11).integers(0, FOLDS, len(y))
    z = np.zeros(len(y))
    for k in range(FOLDS):
        at, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(set(y[at])) == 2:
            z[out] = margins([rows[i] for i in out], *solve(at))
    slope, shift = logistic_curve(z, (y == 1).astype(float), importance / importance.mean())
    ratio, w, b = solve(np.arange(len(y)))
    return Model({g: (float(w[i] * ratio[i]), float(ratio[i] ** 2)) for g, i in place.items()}, b, slope, shift)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS,
          max_chars: int = MAX_CHARS) -> Model:
    """Fit on at most ``per_class`` documents of each class, and no more once they reach ``max_chars`` characters.

    Held-out ids count nowhere, neither in the sample nor in the classes' shares. Of a repeated id the largest label counts; labels
    without a document or without value, and null texts, do not. Without anything to learn from the model scores all texts alike.
    """
    sample = labelled_sample(labels, label, docs, per_class, "quality-sample")
    rows = sample_texts(docs, sample, max_chars, "quality-order").toPandas()
    shares = class_sizes(labels, label, docs)
    if rows.empty:
        return Model({}, 0.0, 0.0, 0.0)
    taken = rows["label"].value_counts()
    importance = rows["label"].map(lambda k: shares[k] / taken[k]).to_numpy(dtype=float)
    return fit(rows["text"].tolist(), (rows["label"].to_numpy() == 1).astype(int), importance)


def probability(text: str, model: Model, forms: Forms) -> float:
    get = model.weights.get
    found = [x for x in map(get, ngrams(text, forms)) if x]
    z = (sum(x[0] for x in found) + model.bias) / np.sqrt(sum(x[1] for x in found) + 1.0)
    return float(1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -40, 40))))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Add ``score`` and ``predicted`` to documents with ``text``.

    A null text is scored like an empty one, which has no indicator and so the score of the intercept alone.
    Columns of these names are replaced, all others kept.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @giving_back
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forms, own = Forms(), shared.value
        for batch in batches:
            yield pd.Series([probability(t or "", own, forms) for t in batch], dtype=float)

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*[F.col(f"`{c}`") for c in kept], scored("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
