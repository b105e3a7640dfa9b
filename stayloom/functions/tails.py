"""Tail probabilities, as small Arrow-batched functions over one-row-per-feature tables.

Spark SQL has no error, gamma or beta function. The continued fractions are the standard ones
(modified Lentz evaluation).
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

TINY = 1e-300
EPS = 1e-15
# Fixed value: sides up to this size are tested exactly when no values tie.
EXACT_SIDE = 8


def _lentz(step, first: float, limit: int = 10_000) -> float:
    """Value of b0 + a1/(b1 + a2/(b2 + …)) with ``step(i) -> (a_i, b_i)`` and ``first`` = b0."""
    f = first or TINY
    c, d = f, 0.0
    for i in range(1, limit):
        a, b = step(i)
        d = 1.0 / ((b + a * d) or TINY)
        c = (b + a / c) or TINY
        f *= c * d
        if abs(c * d - 1.0) < EPS:
            break
    return f


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi2_sf(x: float, dof: float) -> float:
    """Upper tail of the chi-squared distribution: regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    a, h = dof / 2.0, x / 2.0
    log_scale = a * math.log(h) - h - math.lgamma(a)
    if h < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * EPS:
            k += 1.0
            term *= h / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_scale))
    fraction = _lentz(lambda i: (-i * (i - a), h + 2 * i + 1 - a), h + 1 - a)
    return math.exp(log_scale) / fraction


def _beta_fraction(x: float, a: float, b: float) -> float:
    def step(i: int) -> tuple[float, float]:
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0

    return 1.0 / _lentz(step, 1.0)


def incomplete_beta(x: float, a: float, b: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return scale * _beta_fraction(x, a, b) / a
    return 1.0 - scale * _beta_fraction(1.0 - x, b, a) / b


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return incomplete_beta(dof / (dof + t * t), dof / 2.0, 0.5)


def correlation_p(rho: float, n: float) -> float:
    """Two-sided p of a rank correlation, by the t distribution with n - 2 degrees of freedom."""
    if n <= 2 or math.isnan(rho):
        return math.nan
    if abs(rho) >= 1.0:
        return 0.0
    return t_two_sided(rho * math.sqrt((n - 2) / (1.0 - rho * rho)), n - 2)


@lru_cache(maxsize=None)
def _period(n: int) -> tuple[int, list[int]]:
    """``(L, N)`` with 1 / ((1 - q)(1 - q)...(1 - q^n)) = N(q) / (1 - q^L)^(n + 1), L the least common multiple of 1 to n."""
    length = math.lcm(*range(1, n + 1))
    ways = [1]
    for step in (1, *range(1, n + 1)):
        # Times 1 + q^step + ... up to q^(L - step).
        grown = ways + [0] * (length - step)
        for k in range(step, len(grown)):
            grown[k] += grown[k - step]
        for k in range(len(grown) - 1, length - 1, -1):
            grown[k] -= grown[k - length]
        ways = grown
    return length, ways


def _partitions_upto(n: int, total: int) -> int:
    """Partitions of the numbers 0 to ``total`` into parts of at most ``n``."""
    length, ways = _period(n)
    return sum(ways[t] * math.comb((total - t) // length + n, n) for t in range(total % length, min(total + 1, len(ways)), length))


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided p of the larger rank-sum statistic without ties, from its full distribution.

    The distribution is the product of (1 - q^(n2+i)) / (1 - q^i) for i to n1. The numerator has 2^n1 terms, and the
    sums of the rest have a closed form, so the cost does not hang on n2. All numbers are whole.
    """
    top = n1 * n2 - math.ceil(u)  # by symmetry the upper tail from u is the lower one up to here
    if top < 0:
        return 0.0
    below = 0
    for chosen in range(1 << n1):
        shift = sum(n2 + i + 1 for i in range(n1) if chosen >> i & 1)
        if shift <= top:
            below += (-1) ** chosen.bit_count() * _partitions_upto(n1, top - shift)
    return min(1.0, float(Fraction(2 * below, math.comb(n1 + n2, n1))))


def rank_sum_p(u: float, z: float, n1: float, n2: float, tie: float) -> float:
    """Exact for a small side without ties, else the normal limit."""
    if tie == 0 and min(n1, n2) <= EXACT_SIDE:
        return rank_sum_exact(u, int(min(n1, n2)), int(max(n1, n2)))
    return normal_two_sided(z) if z > 0 else 1.0


def _pairwise(fn):
    def apply(a, b):
        return pd.Series([None if pd.isna(x) or pd.isna(y) else fn(float(x), float(y)) for x, y in zip(a, b)],
                         dtype="float64")
    apply.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return apply


def correlation_p_column(rho, n):
    return F.pandas_udf(_pairwise(correlation_p), "double")(rho, n)


def chi2_sf_column(x, dof):
    return F.pandas_udf(_pairwise(chi2_sf), "double")(x, dof)


def rank_sum_p_column(u, z, n1, n2, tie):
    def apply(u, z, n1, n2, tie):
        return pd.Series([None if any(pd.isna(v) for v in row) else rank_sum_p(*row)
                          for row in zip(u, z, n1, n2, tie)], dtype="float64")
    apply.__annotations__ = {**{n: pd.Series for n in ("u", "z", "n1", "n2", "tie")}, "return": pd.Series}
    return F.pandas_udf(apply, "double")(u, z, n1, n2, tie)
