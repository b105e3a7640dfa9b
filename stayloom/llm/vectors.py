"""What the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """False for vectors that are null, empty, zero or hold a null, NaN or infinite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(rows) -> np.ndarray:
    """Vectors of one length as doubles."""
    return np.stack([np.asarray(r, dtype=np.float64) for r in rows])
