"""Least squares with a quadratic penalty for any number of slots, by conjugate gradients.

The matrix of the normal equations is never made: a step multiplies every (sparse) row with the direction and adds up the
rows by that product, so what moves is one vector a task. Columns are centred inside the products and scaled by their
own diagonal entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

CHUNK = 16_384


def sparse_rows(df: DataFrame, features: str, *keep: str) -> DataFrame:
    """``size, indices, values`` of a vector column; dense vectors have no indices."""
    return df.select(*keep, F.unwrap_udt(F.col(features)).alias("v")).select(*keep, "v.indices", "v.values")


def flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of every entry."""
    values = [np.asarray(v, dtype=float) for v in batch["values"]]
    slots = [np.arange(len(v)) if i is None else np.asarray(i, dtype=np.int64) for i, v in zip(batch["indices"], values)]
    row = np.repeat(np.arange(len(values)), [len(v) for v in values])
    none = np.empty(0)
    return row, np.concatenate([none.astype(np.int64), *slots]), np.concatenate([none, *values])


def vector_sum(rows: DataFrame, of: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of vectors of ``size``: within tasks first, then chunk by chunk as they come in."""
    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += of(batch)
        for k in range(0, size, CHUNK):
            yield pd.DataFrame({"k": [k], "v": [total[k:k + CHUNK].tobytes()]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch["k"], batch["v"]):
                own = np.frombuffer(v)
                found[k] = found[k] + own if k in found else own
        for k, own in found.items():
            yield pd.DataFrame({"k": [k], "v": [own.tobytes()]})

    parts = rows.mapInPandas(within, "k int, v binary").repartition(max(1, min(64, -(-size // CHUNK))), "k")
    out = np.zeros(size)
    for r in parts.mapInPandas(merged, "k int, v binary").collect():
        own = np.frombuffer(r["v"])
        out[r["k"]:r["k"] + len(own)] = own
    return out


@dataclass
class LinearModel:
    coefficients: np.ndarray
    intercept: float

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Add ``prediction``."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def predicted(vectors: pd.DataFrame) -> pd.Series:
            own = shared.value
            row, slot, value = flat(vectors)
            return pd.Series(own.intercept + np.bincount(row, weights=value * own.coefficients[slot], minlength=len(vectors)))

        vector = F.unwrap_udt(F.col(features))
        return df.withColumn("prediction", predicted(F.struct(vector["indices"].alias("indices"), vector["values"].alias("values"))))


def ridge_by_gradients(train: DataFrame, slots: int, alpha: float, label: str = "label", features: str = "features",
                       tolerance: float = 1e-11, most_steps: int = 1000) -> LinearModel:
    """Minimise the squared error plus ``alpha`` times the squared weights; the intercept is free.

    Ends when the residual of the normal equations is ``tolerance`` of their right side. One pass over the rows a step.
    """
    rows = written(sparse_rows(train.filter(F.col(label).isNotNull()), features, label), "gradient-rows").persist()

    def moments(batch: pd.DataFrame) -> np.ndarray:
        row, slot, value = flat(batch)
        y = batch[label].to_numpy(dtype=float)
        by = lambda w: np.bincount(slot, weights=w, minlength=slots)
        return np.r_[by(value), by(value * value), by(value * y[row]), len(y), y.sum()]

    sums = vector_sum(rows, moments, 3 * slots + 2)
    n, total = sums[-2:]
    if not n:
        rows.unpersist()
        return LinearModel(np.zeros(slots), 0.0)
    mean, middle = sums[:slots] / n, total / n
    # Products with centred columns: of the right side here, of each direction below.
    right = sums[2 * slots:3 * slots] - mean * total
    scale = np.maximum(sums[slots:2 * slots] - n * mean * mean, 0.0) + alpha
    scale = np.where(scale > 0, scale, 1.0)

    def product(p: np.ndarray) -> np.ndarray:
        offset = float(mean @ p)

        def one(batch: pd.DataFrame) -> np.ndarray:
            row, slot, value = flat(batch)
            along = np.bincount(row, weights=value * p[slot], minlength=len(batch)) - offset
            return np.r_[np.bincount(slot, weights=value * along[row], minlength=slots), along.sum()]

        found = vector_sum(rows, one, slots + 1)
        return found[:slots] - mean * found[slots] + alpha * p

    w, left = np.zeros(slots), right.copy()
    z = left / scale
    p, size = z.copy(), float(left @ z)
    for _ in range(most_steps):
        if np.linalg.norm(left) <= tolerance * np.linalg.norm(right):
            break
        q = product(p)
        step = size / float(p @ q)
        w, left = w + step * p, left - step * q
        z = left / scale
        before, size = size, float(left @ z)
        p = z + size / before * p
    rows.unpersist()
    return LinearModel(w, float(middle - mean @ w))
