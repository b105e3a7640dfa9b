"""Profile of a table that grows: a small state per load, merged without reading old rows again.

The state has one row per column: counts, moments and range, which merge exactly (up to the rounding of sums), and
two sketches of fixed size, for distinct values and for quantiles. ``profile`` has the exact ways over the rows themselves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DISTINCT_BITS = 14  # a relative error of about 0.8 %
QUANTILE_SIZE = 400  # a rank error of about 0.7 %


def profile_state(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, n, nulls, mean, m2, low, high, distinct, quantiles`` of numeric columns. NaN counts as NULL."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("x")) for c in columns])
    x = F.col("x")
    return df.select(F.explode(entries).alias("e")).select("e.*").groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("nulls"), F.avg(x).alias("mean"),
        (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x + F.lit(0.0))), F.lit(DISTINCT_BITS)).alias("distinct"),
        F.kll_sketch_agg_double(x, F.lit(QUANTILE_SIZE)).alias("quantiles"))


def merged_state(states: DataFrame) -> DataFrame:
    """One state from the rows of several, each row some load's. Empty loads, with no row or none that is not NULL, do no harm."""
    filled = F.col("n") - F.col("nulls")
    rows = states.withColumn("k", filled)
    whole = F.sum("k")
    mean = F.sum(F.col("mean") * F.col("k")) / F.nullif(whole, F.lit(0))
    # Sum of squares around the common mean: inside the loads, and of their means around it.
    spread = F.sum("m2") + F.sum(F.col("k") * F.col("mean") * F.col("mean")) - whole * mean * mean
    return rows.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), mean.alias("mean"), F.greatest(spread, F.lit(0.0)).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"))


def read_profile(state: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``feature, n, nulls, mean, std, low, high``, about how many distinct values, and about the ``q..`` quantiles."""
    filled = F.col("n") - F.col("nulls")
    some = filled > 0
    return state.select(
        "feature", "n", "nulls", "mean", F.sqrt(F.col("m2") / F.nullif(filled - 1, F.lit(0))).alias("std"), "low", "high",
        F.when(some, F.hll_sketch_estimate("distinct")).otherwise(F.lit(0)).alias("about_distinct"),
        *[F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q)))).alias(f"q{round(q * 100)}") for q in quantiles])
