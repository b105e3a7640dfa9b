"""Exact ranks and quantiles without putting a whole column or group into one task.

Equal values are first collapsed to ``(value, count)``. If the table is large, the value range is
cut into cells at split points taken from one bounded sketch of the column; positions inside a cell
come from a window over that cell, positions of the cells from their totals. The sketch only
balances the cells: results are exact whatever the split points are.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 1_000_000
MAX_CELLS = 16_384
MAX_HASH_CELLS = 200_000
BUILTIN_GROUP_ROWS = 100_000


def present(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def cell_count(rows: int, cell_rows: int | None = None, most: int = MAX_CELLS) -> int:
    return max(1, min(most, math.ceil(rows / (cell_rows or CELL_ROWS))))


def add_cells(df: DataFrame, columns: Sequence[str], cell_rows: int | None = None) -> DataFrame:
    """Add ``{column}__cell`` for each numeric column (action: a count, and one sketch pass if large)."""
    columns = list(dict.fromkeys(columns))
    cells = cell_count(df.count(), cell_rows)
    names = {c: f"{c}__cell" for c in columns}
    if cells == 1:
        return df.withColumns({n: F.lit(0) for n in names.values()})
    # Adding zero makes -0.0 and 0.0 one value, as they are for grouping.
    df = df.withColumns({c: F.col(c).cast("double") + F.lit(0.0) for c in columns})
    probabilities = [i / cells for i in range(1, cells)]
    found = df.approxQuantile(columns, probabilities, 1.0 / (2 * cells))
    cut, splits = [], []
    for c, points in zip(columns, found):
        points = sorted(set(points or []))
        if points:
            cut.append(c)
            splits.append([-math.inf, *points, math.inf])
    if cut:
        df = Bucketizer(splitsArray=splits, inputCols=cut, outputCols=[names[c] for c in cut],
                        handleInvalid="keep").transform(df)
    return df.withColumns(
        {names[c]: F.col(names[c]).cast("int") if c in cut else F.lit(0) for c in columns})


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep…, feature, value, cell)``, one row per present value of a column prepared by ``add_cells``."""
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 F.col(f"{c}__cell").alias("cell"))
        for c in columns
    ])
    return (
        df.select(*keep, F.explode(entries).alias("e"))
        .select(*keep, "e.feature", "e.value", "e.cell")
        .filter(present(F.col("value")))
    )


def value_ranks(long: DataFrame, keys: Sequence[str], weight: str | None = None, sums: Sequence[str] = ()) -> DataFrame:
    """Per ``keys`` and distinct value: ``cnt``, rows below, rows in the group, average rank, and the totals of ``sums``.

    Input columns: ``keys``, ``value``, ``cell`` (and ``weight`` if rows are already counted).
    """
    keys = list(keys)
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counts = long.groupBy(*keys, "cell", "value").agg(rows.alias("cnt"), *[F.sum(c).alias(c) for c in sums])
    inside = Window.partitionBy(*keys, "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("__inside", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    # At most MAX_CELLS rows per key from here on.
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        counts.groupBy(*keys, "cell").agg(F.sum("cnt").alias("__rows"))
        .select(*keys, "cell",
                F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
                F.sum("__rows").over(Window.partitionBy(*keys)).alias("n"))
    )
    below = F.col("__inside") + F.col("__before")
    return ranked.join(totals, [*keys, "cell"]).select(
        *keys, "value", "cnt", below.alias("below"), "n",
        (below + (F.col("cnt") + 1) / F.lit(2.0)).alias("avg_rank"), *sums)


def _interpolated(ranked: DataFrame, keys: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    """Linear interpolation between the two neighbouring order statistics."""
    def at(position: Column) -> Column:
        inside = (F.col("below") <= position) & (position < F.col("below") + F.col("cnt"))
        return F.max(F.when(inside, F.col("value")))

    picks, results = [], []
    for i, (name, p) in enumerate(probabilities.items()):
        position = (F.col("n") - 1) * F.lit(float(p))
        picks += [at(F.floor(position)).alias(f"__lo{i}"), at(F.ceil(position)).alias(f"__hi{i}"),
                  F.max(position - F.floor(position)).alias(f"__f{i}")]
        lo, hi, f = (F.col(f"__{k}{i}") for k in ("lo", "hi", "f"))
        results.append(((1 - f) * lo + f * hi).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *results)


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    group_rows: int | None = None,
    cell_rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per group, one column per named probability.

    The built-in aggregate keeps every distinct value of a group in one buffer, so it is used only
    after the largest group was measured (action, unless ``largest`` says how many rows it has at most); beyond
    ``group_rows`` the ranks give the result.
    """
    keys = list(keys)
    limit = BUILTIN_GROUP_ROWS if group_rows is None else group_rows
    rows = df.filter(present(F.col(value).cast("double"))).select(
        *keys, F.col(value).cast("double").alias("value"))
    if (largest_group(rows, keys) if largest is None else largest) <= limit:
        return rows.groupBy(*keys).agg(
            *[F.percentile("value", F.lit(float(p))).alias(n) for n, p in probabilities.items()])
    celled = add_cells(rows, ["value"], cell_rows).withColumnRenamed("value__cell", "cell")
    return _interpolated(value_ranks(celled, keys), keys, probabilities)


def largest_group(rows: DataFrame, keys: Sequence[str]) -> int:
    return group_sizes(rows, keys)[0]


def group_sizes(rows: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group, and of all (action)."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = counts.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return found["most"] or 0, found["all"] or 0


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Mapping[str, float],
    group_rows: int | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles of several columns: ``(feature, name…)``, one row per column."""
    limit = BUILTIN_GROUP_ROWS if group_rows is None else group_rows
    columns = list(columns)
    if df.count() <= limit:
        entries = long_values(df.withColumns({f"{c}__cell": F.lit(0) for c in columns}), columns)
        return entries.groupBy("feature").agg(
            *[F.percentile("value", F.lit(float(p))).alias(n) for n, p in probabilities.items()])
    long = long_values(add_cells(df, columns, cell_rows), columns)
    return _interpolated(value_ranks(long, ["feature"]), ["feature"], probabilities)


def quantile_values(df: DataFrame, columns: Sequence[str], probabilities: Mapping[str, float], **kw) -> dict:
    """The same as a dict ``column -> {name: value}``: one row per column reaches the driver (action)."""
    return {
        row["feature"]: {n: row[n] for n in probabilities}
        for row in column_quantiles(df, columns, probabilities, **kw).collect()
    }


def percent_rank_average(column: str, over: Window | None = None) -> Column:
    """Average rank over the number of rows, for one-row-per-feature tables."""
    whole = over or Window.partitionBy(F.lit(0))
    ordered = whole.orderBy(F.col(column))
    ties = F.count(F.lit(1)).over(whole.orderBy(F.col(column)).rangeBetween(0, 0))
    filled = F.count(column).over(whole)
    # NULLs sort first; they get no rank and do not count.
    nulls = F.count(F.lit(1)).over(whole) - filled
    return F.when(F.col(column).isNotNull(),
                  (F.rank().over(ordered) - nulls + (ties - 1) / F.lit(2.0)) / filled)


def md5_number(*columns: Column) -> Column:
    """Number from 0 to 2^60 - 1: the first 15 digits of the MD5 of the columns' text, joined by colons."""
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def dense_index(df: DataFrame, keys: Sequence[str], name: str = "row_index",
                cell_rows: int | None = None, seed: int = 0) -> DataFrame:
    """Number the rows 0, 1, 2, … in the order of an MD5 of seed and ``keys`` (which must be unique), then of the keys.

    Rows are numbered inside cells of neighbouring hashes; the cells' offsets are a table of at most MAX_HASH_CELLS rows.
    """
    cells = cell_count(df.count(), cell_rows, MAX_HASH_CELLS)
    hashed = df.withColumn("__h", md5_number(F.lit(seed), *[F.col(k) for k in keys])).withColumn(
        "__cell", F.expr(f"__h div {-(-2**60 // cells)}").cast("int"))
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy("__h", *keys)) - 1
    before = Window.partitionBy(F.lit(0)).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n")).select(
        "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (
        hashed.withColumn("__inside", inside)
        .join(F.broadcast(offsets), "__cell")
        .withColumn(name, F.col("__inside") + F.col("__offset"))
        .drop("__h", "__cell", "__inside", "__offset")
    )
