"""Association of features with a numeric target: rank correlation, rank tests, information, ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import chi2_sf_column, correlation_p_column, rank_sum_p_column
from ..session import widened, written
from .ranks import add_cells, long_values, percent_rank_average, present, quantile_values, value_ranks
from .skew import HOT_ROWS, lookup_join, split_join, split_threshold

MIN_PAIRS = 30


def _join_ranks(rows: DataFrame, ranks: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Attach ranks; values that hold many rows are split. The ranks already carry the counts."""
    if total <= HOT_ROWS:
        return rows.join(ranks.drop("cnt"), keys)
    limit = split_threshold(total)
    hot = ranks.filter(F.col("cnt") > limit).select(
        *keys, F.ceil(F.col("cnt") / F.lit(float(limit))).cast("int").alias("__splits"))
    return split_join(rows, ranks.drop("cnt"), keys, hot)


def ranked_pairs(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Counts of each distinct ``(x, y)`` with both ranks, per named pair of columns.

    Only rows where both columns are present take part, and both are ranked within those rows.
    Output: ``feature, x, y, weight, n, x_below, x_rank, y_below, y_rank``.
    """
    columns = list(dict.fromkeys(c for _, a, b in pairs for c in (a, b)))
    celled = add_cells(df.select(*columns), columns)
    entries = F.array(*[
        F.struct(F.lit(name).alias("feature"),
                 F.col(a).cast("double").alias("x"), F.col(f"{a}__cell").alias("x_cell"),
                 F.col(b).cast("double").alias("y"), F.col(f"{b}__cell").alias("y_cell"))
        for name, a, b in pairs
    ])
    joint = (
        celled.select(F.explode(entries).alias("e")).select("e.*")
        .filter(present(F.col("x")) & present(F.col("y")))
        .groupBy("feature", "x", "x_cell", "y", "y_cell").agg(F.count(F.lit(1)).alias("weight"))
    )
    total = df.count() * len(pairs)

    def side(v: str) -> DataFrame:
        ranks = value_ranks(
            joint.select("feature", F.col(v).alias("value"), F.col(f"{v}_cell").alias("cell"), "weight"),
            ["feature"], "weight")
        return ranks.select("feature", F.col("value").alias(v), "cnt", F.col("below").alias(f"{v}_below"),
                            F.col("avg_rank").alias(f"{v}_rank"), *(["n"] if v == "x" else []))

    joined = _join_ranks(joint.drop("x_cell", "y_cell"), side("x"), ["feature", "x"], total)
    return _join_ranks(joined, side("y"), ["feature", "y"], total)


def spearman_of(ranked: DataFrame) -> DataFrame:
    """``(feature, rho, n)``. Ranks are centred on their exact mean, so the sums do not cancel."""
    middle = (F.col("n") + 1) / F.lit(2.0)
    dx, dy, w = F.col("x_rank") - middle, F.col("y_rank") - middle, F.col("weight")
    sums = ranked.groupBy("feature").agg(
        F.sum(w * dx * dy).alias("sxy"), F.sum(w * dx * dx).alias("sxx"),
        F.sum(w * dy * dy).alias("syy"), F.max("n").alias("n"))
    return sums.select(
        "feature", (F.col("sxy") / F.nullif(F.sqrt("sxx") * F.sqrt("syy"), F.lit(0.0))).alias("rho"), "n")


def spearman_with_target(df: DataFrame, features: Sequence[str], target: str,
                         min_rows: int = MIN_PAIRS) -> DataFrame:
    """``(feature, rho, n, p_value)`` of features with at least ``min_rows`` complete rows."""
    return (
        rank_correlations(df, [f for f in features if f != target], target).filter(F.col("n") >= min_rows)
        .withColumn("p_value", correlation_p_column(F.col("rho"), F.col("n")))
    )


def rank_correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``(feature, rho, n)`` as ``spearman_of`` gives, with the rows sent once and not once a feature.

    The target is ranked once, with one rank for each set of rows that an incomplete feature leaves. Rows get its ranks; they are
    summed by distinct value of each feature, and the feature's ranks meet those sums, so they need not be joined back to rows.
    """
    columns = list(dict.fromkeys([*features, target]))
    df = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in columns]).filter(F.col(target).isNotNull())
    seen = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    set_of = {f: i for i, f in enumerate((f for f in columns if seen[f]), 1)}
    flags = [f"__has{i}" for i in set_of.values()]
    celled = add_cells(df, columns)
    counted = celled.groupBy(*celled.columns).agg(F.count(F.lit(1)).alias("__weight"))
    long = long_values(celled.withColumns({f"__has{i}": F.col(f).isNotNull() for f, i in set_of.items()}), [target], flags)
    ranks = partner_ranks(long, flags).select(F.col("value").alias(target), "cnt", "centred")
    joined = _join_ranks(counted, ranks, [target], seen["__rows"])
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col(f"{f}__cell").alias("cell"),
                 F.get("centred", F.lit(set_of.get(f, 0))).alias("dy")) for f in features])
    pairs = joined.select("__weight", F.explode(entries).alias("e")).select("__weight", "e.*").filter(F.col("value").isNotNull())
    w, dy = F.col("__weight"), F.col("dy")
    sums = value_ranks(pairs.select("feature", "value", "cell", w.alias("weight"), (w * dy).alias("y"), (w * dy * dy).alias("yy")),
                       ["feature"], "weight", ["y", "yy"])
    dx = F.col("avg_rank") - (F.col("n") + 1) / F.lit(2.0)
    total = sums.groupBy("feature").agg(
        F.sum(dx * F.col("y")).alias("sxy"), F.sum(F.col("cnt") * dx * dx).alias("sxx"), F.sum("yy").alias("syy"), F.max("n").alias("n"))
    return total.select("feature", (F.col("sxy") / F.nullif(F.sqrt("sxx") * F.sqrt("syy"), F.lit(0.0))).alias("rho"), "n")


def group_rank_sums(df: DataFrame, categories: Sequence[str], target: str) -> DataFrame:
    """Per (feature, group): size, rank sum of the target; with the feature's row and tie totals.

    Groups of one row are left out before ranking. Equal targets of a group are one counted row.
    """
    celled = add_cells(df.filter(present(F.col(target).cast("double"))).select(*categories, target), [target])
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("grp")) for c in categories])
    counted = (
        celled.select(F.explode(entries).alias("e"), F.col(target).cast("double").alias("value"),
                      F.col(f"{target}__cell").alias("cell"))
        .select("e.*", "value", "cell").filter(F.col("grp").isNotNull())
        .groupBy("feature", "grp", "value", "cell").agg(F.count(F.lit(1)).alias("weight"))
    )
    sizes = counted.groupBy("feature", "grp").agg(F.sum("weight").alias("n_g"))
    kept = lookup_join(counted, sizes.filter("n_g >= 2"), ["feature", "grp"])
    # A distinct target value has at most one counted row per group, so this join cannot be hot.
    ranks = value_ranks(kept, ["feature"], "weight")
    ranked = kept.join(ranks, ["feature", "value"])
    groups = ranked.groupBy("feature", "grp").agg(
        F.max("n_g").alias("n_g"), F.sum(F.col("weight") * F.col("avg_rank")).alias("rank_sum"),
        F.max("n").alias("n"))
    c = F.col("cnt").cast("double")
    ties = ranks.groupBy("feature").agg(F.sum(c * c * c - c).alias("tie"))
    return groups.join(F.broadcast(ties), "feature")


def rank_tests(df: DataFrame, categories: Sequence[str], target: str) -> DataFrame:
    """``(feature, test, statistic, p_value, n_groups)``: two groups Mann-Whitney, more Kruskal-Wallis.

    The two-group statistic is U of the first group in sorted order. Its p is exact for a side of up
    to eight without ties, else the normal limit with tie and continuity correction.
    """
    groups = group_rank_sums(df, categories, target)
    n, ng, r = F.col("n"), F.col("n_g"), F.col("rank_sum")
    off = r / ng - (n + 1) / F.lit(2.0)
    per = groups.groupBy("feature").agg(
        F.count(F.lit(1)).cast("int").alias("n_groups"), F.max("n").cast("double").alias("n"),
        F.max("tie").alias("tie"), F.sum(ng * off * off).alias("between"),
        F.min_by(F.struct(ng.cast("double").alias("n1"), r.alias("r1")), "grp").alias("first"),
        F.sum(ng).alias("rows"))
    n = F.col("n")
    n1 = F.col("first.n1")
    n2 = n - n1
    u = F.col("first.r1") - n1 * (n1 + 1) / 2
    middle = n1 * n2 / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = (F.greatest(u, n1 * n2 - u) - middle - 0.5) / F.nullif(spread, F.lit(0.0))
    h = F.lit(12.0) / (n * (n + 1)) * F.col("between") / F.nullif(
        1 - F.col("tie") / (n * n * n - n), F.lit(0.0))
    two = F.col("n_groups") == 2
    tested = per.filter("n_groups >= 2").select(
        "feature", F.when(two, F.lit("Mann-Whitney U")).otherwise(F.lit("Kruskal-Wallis")).alias("test"),
        F.when(two, u).otherwise(h).alias("statistic"), "n_groups",
        F.when(two, z).alias("z"), F.when(two, F.greatest(u, n1 * n2 - u)).alias("larger"),
        F.when(two, n1).alias("n1"), F.when(two, n2).alias("n2"), "tie", (F.col("n_groups") - 1).alias("dof"))
    # One row per feature from here on.
    p_two = rank_sum_p_column(F.col("larger"), F.col("z"), F.col("n1"), F.col("n2"), F.col("tie"))
    p_many = chi2_sf_column(F.col("statistic"), F.col("dof"))
    return tested.withColumn(
        "p_value", F.when(F.col("n_groups") == 2, p_two).otherwise(p_many)
    ).select("feature", "test", "statistic", "p_value", "n_groups")


def fdr_bh(results: DataFrame, p: str = "p_value", alpha: float = 0.05,
           family: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg over a one-row-per-test table: ``p_adj`` and ``significant``.

    ``family`` columns separate sets of tests. Rows without p are left out.
    """
    tests = results.filter(present(F.col(p)))
    family = list(family) or [F.lit(0)]
    whole = Window.partitionBy(*family)
    order = whole.orderBy(F.col(p), "feature") if "feature" in results.columns else whole.orderBy(p)
    ranked = tests.withColumn("__r", F.row_number().over(order)).withColumn(
        "__m", F.count(F.lit(1)).over(whole))
    down = whole.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.withColumn("p_adj", F.least(
            F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__r")).over(down)))
        .withColumn("significant", F.col("p_adj") <= alpha).drop("__r", "__m")
    )


def test_counts(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("n_tested"),
        F.count_if(F.col("p_value") < alpha).alias("n_raw"),
        F.count_if(F.col("significant")).alias("n_fdr"))


test_counts.__test__ = False


def binned_information(ranked: DataFrame, bins: int = 10) -> DataFrame:
    """``(feature, MI)`` in nats over equal-frequency bins; equal values share a bin."""
    bin_of = lambda v: F.floor(F.col(f"{v}_below") * bins / F.col("n")).cast("int")
    # At most bins * bins rows per feature from here on.
    cells = ranked.groupBy("feature", bin_of("x").alias("bx"), bin_of("y").alias("by")).agg(
        F.sum("weight").cast("double").alias("c"), F.max("n").alias("n"))
    return cell_information(cells)


def cell_information(cells: DataFrame) -> DataFrame:
    """``(feature, MI)`` in nats from the rows ``c`` of each ``(feature, bx, by)`` and those of the feature, ``n``."""
    cx = F.sum("c").over(Window.partitionBy("feature", "bx"))
    cy = F.sum("c").over(Window.partitionBy("feature", "by"))
    term = cells.select("feature", (F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (cx * cy))).alias("t"))
    return term.groupBy("feature").agg(F.sum("t").alias("MI"))


def bin_starts(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[tuple[int, float]]]:
    """``(bin, smallest value)`` of the equal-frequency bins of each column that hold a value, last first (action).

    A bin grows with the value, so at most ``bins`` rows a column tell the bin of every row.
    """
    ranked = value_ranks(long_values(add_cells(df, columns), columns), ["feature"])
    place = F.floor(F.col("below") * bins / F.col("n")).cast("int")
    found: dict[str, list[tuple[int, float]]] = {c: [] for c in columns}
    for r in ranked.groupBy("feature", place.alias("bin")).agg(F.min("value").alias("start")).collect():
        found[r["feature"]].append((r["bin"], r["start"]))
    return {c: sorted(own, reverse=True) for c, own in found.items()}


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Information about the target after median imputation of the features; rows need a target."""
    features = [f for f in features if f != target]
    rows = df.filter(present(F.col(target).cast("double"))).select(*features, target)
    medians = quantile_values(rows, features, {"m": 0.5})
    rows = rows.withColumns({
        f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(medians[f]["m"]))
        for f in features if f in medians})
    features = [f for f in features if f in medians]
    starts = bin_starts(rows.select(*features, target), [*features, target], bins)

    def bin_of(column: str) -> Column:
        return F.coalesce(*[F.when(F.col(column).cast("double") >= F.lit(start), F.lit(b)) for b, start in starts[column]], F.lit(0))

    # Rows are counted by bins where they are: at most bins * bins counts a feature leave a task.
    placed = rows.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), bin_of(f).alias("bx"), bin_of(target).alias("by")) for f in features])).alias("e")).select("e.*")
    cells = placed.groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).cast("double").alias("c"))
    return cell_information(cells.withColumn("n", F.sum("c").over(Window.partitionBy("feature"))))


def spearman_matrix(df: DataFrame, id_column: str, features: Sequence[str]) -> DataFrame:
    """``(feature_a, feature_b, rho)`` of every ordered pair, pairwise complete; undefined is 0.

    A column is ranked once, with one rank for each set of rows that a partner leaves: all rows, for partners without
    NULLs, and the rows where an incomplete partner is present. A row then holds all its ranks, and no row is repeated
    by pair: complete columns are correlated as vectors, pairs with an incomplete column by sums over the rows of a task.
    """
    features = list(features)
    spark = df.sparkSession
    df = df.select(id_column, *[F.nanvl(F.col(f).cast("double"), F.lit(None)).alias(f) for f in features])
    holes = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    complete = [f for f in features if holes[f] == 0]
    open_ = [f for f in features if holes[f] > 0]
    values: list[tuple[str, str, float]] = []
    rows = df.count()
    celled = add_cells(df, features).withColumns({f"__has{i}": F.col(f).isNotNull() for i, f in enumerate(open_)})
    flags = [f"__has{i}" for i in range(len(open_))]
    long = long_values(celled, features, [id_column, *flags])
    joined = _join_ranks(long.drop("cell", *flags), partner_ranks(long, flags), ["feature", "value"], rows * len(features))
    wide = joined.groupBy(id_column).pivot("feature", features).agg(F.first("centred"))
    # Rows times features are what the joins and sorts below hold.
    if open_:
        with widened(spark, rows * len(features)):
            wide = written(wide, "partner-ranks")
    if len(complete) > 1:
        whole = wide.select(*[F.get(F.col(f), F.lit(0)).alias(f) for f in complete])
        vectors = VectorAssembler(inputCols=complete, outputCol="v").transform(whole).select("v")
        with widened(spark, rows * len(features)):
            matrix = Correlation.corr(vectors, "v", "pearson").first()[0].toArray()
        values = [(a, b, float(matrix[i][j]))
                  for i, a in enumerate(complete) for j, b in enumerate(complete) if i != j]
    result = spark.createDataFrame(values, "feature_a string, feature_b string, rho double")
    loose = [(a, b) for a, b in combinations(features, 2) if a in open_ or b in open_]
    if loose:
        rho = partner_correlations(wide, features, open_, loose)
        for x, y in (("a", "b"), ("b", "a")):
            result = result.unionByName(rho.select(
                F.col(x).alias("feature_a"), F.col(y).alias("feature_b"), "rho"))
    same = spark.createDataFrame([(f, f, 1.0) for f in features], result.schema)
    return result.unionByName(same).withColumn("rho", F.coalesce(F.nanvl("rho", F.lit(0.0)), F.lit(0.0)))


def partner_ranks(long: DataFrame, flags: Sequence[str]) -> DataFrame:
    """``feature, value, cnt, centred``: the ranks of each distinct value, less their mean, among the rows of each set.

    The first set is all rows with the feature, the others those where a flag holds too. One pass over the counted
    values gives them all, as running sums of one column a set.
    """
    sets = range(len(flags) + 1)
    counts = long.groupBy("feature", "cell", "value").agg(
        F.count(F.lit(1)).alias("c0"), *[F.count_if(F.col(f)).alias(f"c{i}") for i, f in enumerate(flags, 1)])
    inside = Window.partitionBy("feature", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    # At most MAX_CELLS rows per feature.
    cells = counts.groupBy("feature", "cell").agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in sets])
    before = Window.partitionBy("feature").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.select(
        "feature", "cell", *[F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"b{i}") for i in sets],
        *[F.sum(f"t{i}").over(Window.partitionBy("feature")).alias(f"n{i}") for i in sets])
    placed = counts.select("*", *[F.coalesce(F.sum(f"c{i}").over(inside), F.lit(0)).alias(f"i{i}") for i in sets])
    rank = lambda i: F.col(f"i{i}") + F.col(f"b{i}") + (F.col(f"c{i}") - F.col(f"n{i}")) / F.lit(2.0)
    return placed.join(totals, ["feature", "cell"]).select(
        "feature", "value", F.col("c0").alias("cnt"), F.array(*[rank(i) for i in sets]).alias("centred"))


def partner_correlations(wide: DataFrame, features: Sequence[str], open_: Sequence[str],
                         pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``(a, b, rho)`` from rows that hold each feature's ranks (or NULL) by set of rows; sums are made within tasks."""
    place = {f: i for i, f in enumerate(features)}
    of = {f: i for i, f in enumerate(open_, 1)}
    left, right = (np.array([place[p[k]] for p in pairs]) for k in (0, 1))
    left_set, right_set = (np.array([of.get(p[1 - k], 0) for p in pairs]) for k in (0, 1))
    sets = len(open_) + 1

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, len(pairs)))
        for batch in batches:
            x = np.full((len(batch), len(features), sets), np.nan)
            for i, f in enumerate(features):
                have = batch[f].notna().to_numpy()
                if have.any():
                    x[have, i] = np.stack(batch[f][have].to_numpy())
            for rows in np.array_split(x, -(-len(x) * len(pairs) // 1_000_000) or 1):
                p, q = rows[:, left, left_set], rows[:, right, right_set]
                p, q = np.where(np.isnan(q), 0.0, p), np.where(np.isnan(p), 0.0, q)
                p, q = np.nan_to_num(p), np.nan_to_num(q)
                total += [(p * q).sum(axis=0), (p * p).sum(axis=0), (q * q).sum(axis=0)]
        yield pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "xy": total[0], "xx": total[1], "yy": total[2]})

    sums = wide.select(*features).mapInPandas(summed, "a string, b string, xy double, xx double, yy double")
    return sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy")]).select(
        "a", "b", (F.col("xy") / F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))).alias("rho"))


def redundant_pairs(matrix: DataFrame, limit: float = 0.7) -> DataFrame:
    """Each unordered pair with |rho| above the limit, once."""
    return matrix.filter((F.col("feature_a") < F.col("feature_b")) & (F.abs("rho") > limit))


def combined_ranking(information: DataFrame, correlations: DataFrame) -> DataFrame:
    """Mean of the two percentile ranks; both inputs have one row per feature."""
    joined = information.join(
        correlations.withColumn("abs_rho", F.abs("rho")), "feature", "left")
    scored = joined.withColumn("MI_pct", percent_rank_average("MI")).withColumn(
        "rho_pct", percent_rank_average("abs_rho"))
    return scored.withColumn("score", (F.col("MI_pct") + F.col("rho_pct")) / 2).orderBy(
        F.col("score").desc(), "feature")


def strong_features(results: DataFrame, min_abs_rho: float = 0.05, n: int = 50) -> list[str]:
    """Names of the significant features by |rho| (action on a one-row-per-feature table)."""
    rows = (
        results.filter(F.col("significant") & (F.abs("rho") > min_abs_rho))
        .orderBy(F.abs("rho").desc(), "feature").limit(n).select("feature").collect()
    )
    return [r["feature"] for r in rows]
