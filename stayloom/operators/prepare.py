"""Cohort filters, imputation, category maps, encoding, outlier fences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import quantile_values
from .skew import lookup_join


def select_existing(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, in wanted order, and the names not found."""
    there = set(df.columns)
    return df.select(*[c for c in wanted if c in there]), [c for c in wanted if c not in there]


def cohort_filter(df: DataFrame, flag: str = "EXPIRE_FLAG", keep: int = 0) -> DataFrame:
    """Keep one value of the flag and drop the flag column."""
    return df.filter(F.col(flag) == keep).drop(flag)


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Zero for NULL in the named columns that exist (all numeric columns if none are named)."""
    if columns is None:
        return df.fillna(0)
    return df.fillna(0, subset=[c for c in columns if c in df.columns])


@dataclass(frozen=True)
class MedianImputer:
    """Column medians taken from one table and applied to any."""

    medians: Mapping[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], **kw) -> MedianImputer:
        columns = [c for c in columns if c in df.columns]
        found = quantile_values(df, columns, {"m": 0.5}, **kw) if columns else {}
        return cls({c: v["m"] for c, v in found.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m))
            for c, m in self.medians.items() if c in df.columns})


def map_category(df: DataFrame, mapping: DataFrame, column: str = "DIAGNOSIS",
                 key: str = "diagnosis", value: str = "category", sequence: str | None = None) -> DataFrame:
    """Replace a text by its category; both sides trimmed, no match gives NULL.

    Of repeated texts the row with the largest ``sequence`` counts. Without a sequence they must agree, as rows
    of a table have no order (one small check).
    """
    rows = mapping.filter(F.col(key).isNotNull()).groupBy(F.trim(key).alias("__key"))
    if sequence:
        lookup = rows.agg(F.max_by(value, sequence).alias("__category"))
    else:
        lookup = rows.agg(F.max(value).alias("__category"), F.min(value).alias("__least"))
        if lookup.filter("__category <> __least").limit(1).count():
            raise ValueError("a text has several categories; name a sequence column")
        lookup = lookup.drop("__least")
    joined = lookup_join(df.withColumn("__key", F.trim(column)), lookup, ["__key"], "left")
    return joined.withColumn(column, F.col("__category")).drop("__key", "__category").select(*df.columns)


def rare_to_other(df: DataFrame, column: str, keep: int, other: str = "OTHER") -> DataFrame:
    """The ``keep`` most frequent categories stay, the rest become one; NULL stays NULL."""
    top = [
        r[column] for r in df.filter(F.col(column).isNotNull()).groupBy(column).agg(
            F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(keep).collect()]
    c = F.col(column)
    return df.withColumn(column, F.when(c.isNull() | c.isin(top), c).otherwise(F.lit(other)))


@dataclass(frozen=True)
class OneHot:
    """0/1 columns per category, fitted on one table so that any table gets the same columns."""

    categories: Mapping[str, Sequence[str]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], drop_first: bool = False) -> OneHot:
        """Sorted distinct values per column, from one scan.

        An action: the categories become columns, so they must be few enough for a table's width. For more use
        ``learn.encoder``, which makes one sparse vector.
        """
        pairs = F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])).alias("p")
        rows = df.select(pairs).select("p.i", "p.v").filter("v IS NOT NULL").distinct().orderBy("i", "v").collect()
        found: dict[str, list[str]] = {c: [] for c in columns}
        for r in rows:
            found[columns[r["i"]]].append(r["v"])
        return cls({c: values[1 if drop_first else 0:] for c, values in found.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        """NULL and unseen categories are zero everywhere."""
        dummies = [
            F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
            for c, values in self.categories.items() for v in values]
        return df.select(*[c for c in df.columns if c not in self.categories], *dummies)


def align_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns of ``like`` in its order; those ``df`` lacks are 0, others are dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in like.columns])


def outlier_bounds(df: DataFrame, target: str, **kw) -> tuple[float, float]:
    """Lower fence max(0, Q1 - 1.5 IQR), upper fence the 99th percentile (action)."""
    q = quantile_values(df, [target], {"q1": 0.25, "q3": 0.75, "p99": 0.99}, **kw)[target]
    return max(0.0, q["q1"] - 1.5 * (q["q3"] - q["q1"])), q["p99"]


def within_bounds(df: DataFrame, target: str, low: float, high: float) -> DataFrame:
    """Rows outside the fence go; rows without a target stay."""
    t = F.col(target)
    return df.filter(t.isNull() | t.between(low, high))


def flagged_counts(df: DataFrame, target: str, low: float, high: float) -> DataFrame:
    t = F.col(target)
    return df.agg(F.count_if(t < low).alias("n_low"), F.count_if(t > high).alias("n_high"),
                  F.count(F.lit(1)).alias("n_rows"))


def before_after(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """Rows, median and mean of the target on both sides of a step."""
    spark = before.sparkSession
    rows = []
    for name, df in (("before", before), ("after", after)):
        stats = df.agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("m")).first()
        median = quantile_values(df, [target], {"m": 0.5}).get(target, {}).get("m")
        rows.append((name, stats["n"], median, stats["m"]))
    return spark.createDataFrame(rows, "step string, n_rows long, median double, mean double")


def columns_to_train(df: DataFrame, target: str, derived: Sequence[str] = (),
                     drop: Sequence[str] = ()) -> list[str]:
    """Feature columns: everything but the target, what is derived from it, and the named columns."""
    out = {target, *derived, *drop, f"{target}_log"}
    return [c for c in df.columns if c not in out]

