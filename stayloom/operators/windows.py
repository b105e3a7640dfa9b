"""Events inside per-entity time windows (closed on both ends)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import grid_join, lookup_join


def add_window_end(df: DataFrame, start: str, hours: int = 24, name: str = "END_FIRST_24H") -> DataFrame:
    return df.withColumn(name, F.col(start) + F.expr(f"INTERVAL {int(hours)} HOURS"))


def time_reference(base: DataFrame, id_column: str, columns: list[str], start: str) -> DataFrame:
    """One row per id. Rows without id or start are dropped; among copies the earliest start stays."""
    rest = [c for c in columns if c != id_column]
    return (
        base.dropna(subset=[id_column, start])
        .groupBy(id_column)
        .agg(F.min_by(F.struct(*rest), F.struct(start, *rest)).alias("__row"))
        .select(id_column, *[F.col(f"__row.{c}").alias(c) for c in rest])
        .select(*columns)
    )


def filter_by_window(
    events: DataFrame,
    reference: DataFrame,
    key: str = "ICUSTAY_ID",
    time: str = "CHARTTIME",
    start: str = "INTIME",
    end: str = "END_FIRST_24H",
    value: str | None = "VALUENUM",
    drop_null_values: bool = True,
    max_bytes: int | None = None,
) -> DataFrame:
    """Inner join on ``key``, then ``start <= time <= end``; one window per key expected."""
    if drop_null_values and value:
        events = events.filter(F.col(value).isNotNull())
    events = events.filter(F.col(key).isNotNull())
    reference = _without_shared(events, reference, [key]).filter(F.col(key).isNotNull())
    joined = lookup_join(events, reference, [key], "inner", max_bytes)
    return joined.filter(F.col(time).between(F.col(start), F.col(end)))


def filter_by_windows(
    events: DataFrame,
    reference: DataFrame,
    key: str,
    time: str,
    start: str,
    end: str,
    value: str | None = None,
    drop_null_values: bool = True,
    bucket_seconds: int = 86_400,
    max_bytes: int | None = None,
) -> DataFrame:
    """As ``filter_by_window`` for keys with many windows: an event counts once for each window it is in.

    Windows are sorted into classes by length, each twice as long as the one before, and laid out over time buckets
    as long as their class: every window, however long, lies in at most two buckets. Events look into one bucket
    of each class that occurs (one small action finds them) and join on ``(key, class, bucket)``, so a key with many
    events and many windows does not pair all of them; a bucket with many of both is cut on both sides. One output row per
    (event, window) pair.
    """
    if drop_null_values and value:
        events = events.filter(F.col(value).isNotNull())
    width = lambda level: F.lit(bucket_seconds) * F.pow(F.lit(2.0), level)
    bucket = lambda c, level: F.floor(_epoch(c) / width(level))
    length = _epoch(F.col(end)) - _epoch(F.col(start))
    level = F.ceil(F.log2(F.greatest(length / F.lit(float(bucket_seconds)), F.lit(1.0)))).cast("int")
    right = (
        _without_shared(events, reference, [key])
        .filter(F.col(key).isNotNull() & (F.col(start) <= F.col(end)))
        .withColumn("__level", level)
        .withColumn("__bucket", F.explode(F.array_distinct(F.array(
            bucket(F.col(start), F.col("__level")), bucket(F.col(end), F.col("__level"))))))
    )
    levels = sorted(r[0] for r in right.select("__level").distinct().collect())  # at most some forty
    left = (
        events.filter(F.col(key).isNotNull())
        .withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
        .withColumn("__bucket", bucket(F.col(time), F.col("__level")))
    )
    joined = grid_join(left, right, [key, "__level", "__bucket"], max_bytes)
    return joined.filter(F.col(time).between(F.col(start), F.col(end))).drop("__level", "__bucket")


def _epoch(c):
    return F.unix_seconds(c.cast("timestamp"))


def _without_shared(events: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Columns both sides carry keep the reference's copy out, so names stay unique."""
    return reference.drop(*[c for c in reference.columns if c in events.columns and c not in keys])
