"""Joins that stay balanced when one key holds a large part of the rows.

A side is broadcast only after its rows and bytes were measured. Beyond that size the join
shuffles, and the keys that hold too many rows are split over several tasks. The table of such
keys is small by counting: at most ``MAX_HOT_KEYS`` keys can each hold more than
``rows / MAX_HOT_KEYS`` rows, so it may always be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import session
from ..session import Measure, by_rows, row_bytes, widened, written

BROADCAST_BYTES = 32 * 1024 * 1024
HOT_ROWS = 2_000_000
MAX_HOT_KEYS = 100_000
NULL_SPLITS = 1024


def measured_bytes(df: DataFrame) -> int:
    """Row payload of ``df`` in bytes (action; one partial aggregate per task)."""
    fixed, variable = row_bytes(df)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(variable).alias("b")).first()
    return row["n"] * (fixed + 16) + (row["b"] or 0)


def fits_broadcast(df: DataFrame, max_bytes: int | None = None, known: Measure | None = None) -> bool:
    return (known.bytes if known else measured_bytes(df)) <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def hot_threshold(rows: int) -> int:
    """A key with more rows than this is split."""
    return max(HOT_ROWS, rows // MAX_HOT_KEYS)


def split_threshold(rows: int) -> int:
    """The same where splitting a key repeats lookup rows only, not another long side: the rows of a task, if that is less."""
    return max(min(HOT_ROWS, session.TASK_ROWS), rows // MAX_HOT_KEYS)


def hot_keys(df: DataFrame, keys: Sequence[str], rows: int, limit: int | None = None) -> DataFrame:
    """``(keys, __splits)`` of the keys above the threshold; at most MAX_HOT_KEYS rows."""
    limit = limit or hot_threshold(rows)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.filter(F.col("__n") > limit).select(
        *keys, F.ceil(F.col("__n") / F.lit(float(limit))).cast("int").alias("__splits")
    )


def split_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], hot: DataFrame, how: str = "inner", rows: int | None = None
) -> DataFrame:
    """Equi-join in which each hot key of ``big`` is spread over ``__splits`` tasks.

    The split number is a hash of the row, the same if a lost task runs again. A hot key whose rows are all
    equal stays in one task; such copies are best counted before the join. Rows with a NULL key match nothing and
    may go anywhere. ``rows`` of ``big``, if known, set the number of tasks.
    """
    keys = list(keys)
    hot = F.broadcast(hot)
    splits = F.when(_any_null(keys), F.lit(NULL_SPLITS)).otherwise(F.coalesce(F.col("__splits"), F.lit(1)))
    left = big.join(hot, keys, "left").withColumn(
        "__salt", F.pmod(row_hash(big), splits).cast("int")).drop("__splits")
    right = small.join(hot, keys, "left").withColumn(
        "__salt",
        F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__splits"), F.lit(1)) - 1)),
    ).drop("__splits")
    return by_rows(left, rows, *keys, "__salt").join(right, keys + ["__salt"], how).drop("__salt")


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns that can be hashed (maps cannot)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def nulls_apart(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``left`` or ``left_anti`` join in which left rows without a key are spread, not sent to one task."""
    keys = list(keys)
    part = F.when(_any_null(keys), F.pmod(row_hash(left), F.lit(NULL_SPLITS)).cast("int")).otherwise(F.lit(-1))
    return left.withColumn("__part", part).join(
        right.withColumn("__part", F.lit(-1)), [*keys, "__part"], how).drop("__part")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    max_bytes: int | None = None,
    small_size: Measure | None = None,
    big_rows: int | None = None,
) -> DataFrame:
    """Join a long table to a lookup side: broadcast if measured small, else shuffle with hot keys split.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``. Sizes that are known, as from ``session.measured``, are
    not measured again.
    """
    keys = list(keys)
    if fits_broadcast(small, max_bytes, small_size):
        return big.join(F.broadcast(small), keys, how)
    rows = big.count() if big_rows is None else big_rows
    if rows <= HOT_ROWS:
        return big.join(small, keys, how)
    with widened(big.sparkSession, rows):
        hot = written(hot_keys(big, keys, rows, split_threshold(rows)), "hot-keys")
    return split_join(big, small, keys, hot, how, rows)


def grid_join(left: DataFrame, right: DataFrame, keys: Sequence[str], max_bytes: int | None = None) -> DataFrame:
    """Inner equi-join in which a key may hold many rows on both sides.

    A hot key is cut on both sides: its rows of one side go to one of ``m`` strips, those of the other to one of ``n``, and
    each of the ``m * n`` tasks meets one strip of either. A task holds about a threshold's rows of both sides; a row
    is sent once for each strip of the other side. Rows that are all equal stay together, as in ``split_join``.
    """
    keys = list(keys)
    if fits_broadcast(right, max_bytes):
        return left.join(F.broadcast(right), keys)
    rows = max(left.count(), right.count())
    if rows <= HOT_ROWS:
        return left.join(right, keys)
    met = [*keys, "__m_strip", "__n_strip"]
    cut_left, cut_right = grid_sides(left, right, keys, rows)
    return cut_left.join(cut_right, met).drop("__m_strip", "__n_strip")


def grid_sides(left: DataFrame, right: DataFrame, keys: Sequence[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the strips they meet in; ``rows`` of the larger one set the threshold."""
    hot = [hot_keys(side, keys, rows).withColumnRenamed("__splits", name) for side, name in ((left, "__m"), (right, "__n"))]
    # At most 2 * MAX_HOT_KEYS rows.
    cut = F.broadcast(hot[0].join(hot[1], keys, "full").fillna(1, ["__m", "__n"]))

    def strips(side: DataFrame, own: str, other: str) -> DataFrame:
        number = lambda c: F.coalesce(F.col(c), F.lit(1))
        cell = F.explode(F.sequence(F.lit(0), number(other) - 1))
        return side.join(cut, keys, "left").withColumn(f"{own}_strip", F.pmod(row_hash(side), number(own)).cast("int")).withColumn(
            f"{other}_strip", cell).drop("__m", "__n")

    return strips(left, "__m", "__n"), strips(right, "__n", "__m")


def left_join_many(one: DataFrame, many: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a table with one row per key to one with many.

    The many side is the one that may be hot, and a left join cannot split its right side: the
    matches come from it by a lookup, and the rows of ``one`` without a match are added.
    """
    keys = list(keys)
    matched = lookup_join(many, one, keys)
    lonely = nulls_apart(one, many.select(*keys).distinct(), keys, "left_anti")
    columns = [*one.columns, *[c for c in many.columns if c not in one.columns]]
    return matched.unionByName(lonely, allowMissingColumns=True).select(*columns)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by keys into at least one task per core.

    For model and Python work, whose cost per byte is high: the size-based merging of small
    partitions would leave it to a few tasks. A following group-by or join on the keys reuses it.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)
