"""Null profiles, counts, summaries, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranks import column_quantiles, grouped_quantiles, present

# The summary quartiles and the extended percentile list of the outlier report.
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
REPORT_PERCENTILES = {"p01": .01, "p05": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95, "p99": .99}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def null_profile(df: DataFrame) -> DataFrame:
    """``(column, null_count, null_percentage)``, worst first; one pass over the data."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count")) for c in df.columns])
    share = F.when(F.col("__rows") > 0, F.col("null_count") * 100.0 / F.col("__rows"))
    return (
        counts.select("__rows", F.explode(entries).alias("e")).select("__rows", "e.*")
        .select("column", "null_count", share.alias("null_percentage"))
        .orderBy(F.col("null_percentage").desc(), "column")
    )


def row_and_null_count(df: DataFrame, column: str) -> DataFrame:
    rows, nulls = F.count(F.lit(1)), F.count_if(F.col(column).isNull())
    return df.agg(rows.alias("n_rows"), nulls.alias("n_null"),
                  F.when(rows > 0, nulls / rows).alias("null_share"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null values, most frequent first."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)
    )


def category_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n_categories"))


def summary(df: DataFrame, columns: Sequence[str], percentiles: dict[str, float] = QUARTILES) -> DataFrame:
    """Exact count, mean, std, min, quantiles, max per column: one row per column."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    v = F.col("value")
    moments = (
        df.select(F.explode(entries).alias("e")).select("e.*").filter(present(v))
        .groupBy("feature")
        .agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
             F.min(v).alias("min"), F.max(v).alias("max"))
    )
    # Both sides have one row per column.
    return moments.join(F.broadcast(column_quantiles(df, columns, percentiles)), "feature", "left")


def group_quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles per group, largest median first: the table behind a box plot."""
    rows = df.filter(F.col(group).isNotNull())
    return grouped_quantiles(rows, [group], value, QUARTILES).orderBy(F.col("q50").desc(), group)


def histogram(df: DataFrame, column: str, bins: int = 80,
              low: float | None = None, high: float | None = None) -> DataFrame:
    """``(bin, left_edge, right_edge, n)``: equal bins over the range, last one closed, empty ones kept."""
    v = F.col(column).cast("double")
    rows = df.filter(present(v)).select(v.alias("v"))
    if low is None or high is None:
        edge = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        low = edge["lo"] if low is None else low
        high = edge["hi"] if high is None else high
    spark = df.sparkSession
    if low is None:
        return spark.createDataFrame([], "bin int, left_edge double, right_edge double, n long")
    width = (float(high) - float(low)) / bins or 1.0
    which = F.least(F.floor((F.col("v") - F.lit(float(low))) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = rows.filter(F.col("v").between(low, high)).groupBy(which.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(float(low)) + F.col("id") * width).alias("left_edge"),
        (F.lit(float(low)) + (F.col("id") + 1) * width).alias("right_edge"))
    return edges.join(F.broadcast(counts), "bin", "left").fillna(0, subset=["n"])


def distinct_text(df: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed non-null values."""
    return df.filter(F.col(column).isNotNull()).select(F.trim(column).alias(column)).distinct()


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``; a mergeable aggregate rather than a sort per key."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order, *rest)).alias("__r"))
        .select(key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)
    )


def shuffled_within_partitions(df: DataFrame, seed: int = 42) -> DataFrame:
    return df.sortWithinPartitions(F.rand(seed))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def top_rows(df: DataFrame, by: str, n: int, descending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    key = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.orderBy(key, *ties).limit(n)


def keep_last(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """Latest row of each key by load sequence."""
    rest = [c for c in df.columns if c != key]
    return (
        df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(sequence, *rest)).alias("__r"))
        .select(key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)
    )
