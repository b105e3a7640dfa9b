"""Grouped split, regressors, search, permutation importance, on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .boost import Setting, boost, error_curve, shuffled_errors
from .boost import Model as TreeModel
from .boost import predict as predict_trees
from .gradient import ridge_by_gradients
from .ranks import dense_index, quantile_values
from .skew import spread

# Split rule, target cap, learner settings and search grid of the original models.
SPLIT_BUCKETS = 10
NORMAL_SLOTS = 4096  # the most that Spark's normal solver takes
TRAIN_BUCKETS = 8
VALIDATION_BUCKET = 7
TARGET_CAP_DAYS = 30.0
RIDGE_ALPHA = 1.0
TREES = 500
SEARCH_TREES = 300
LEARNING_RATE = 0.05
TWEEDIE_POWER = 1.5
GRID_RATES = [0.03, 0.05, 0.1]
GRID_POWERS = [1.3, 1.5, 1.7]
PERMUTATION_REPEATS = 5
SEED = 42
# 31, 63 and 127 leaves are trees of depth 5, 6 and 7.
DEPTH = 6
GRID_DEPTHS = [5, 6, 7]
TREE_SETTING = Setting(DEPTH, LEARNING_RATE, TWEEDIE_POWER)


def split_by_subject(df: DataFrame, subject: str = "SUBJECT_ID") -> tuple[DataFrame, DataFrame]:
    """About 80/20 by the id, so that no person is on both sides."""
    bucket = F.pmod(F.col(subject), F.lit(SPLIT_BUCKETS))
    return df.filter(bucket < TRAIN_BUCKETS), df.filter(bucket >= TRAIN_BUCKETS)


def validation_split(train: DataFrame, subject: str = "SUBJECT_ID") -> tuple[DataFrame, DataFrame]:
    """One id digit of the training side serves for choosing parameters, so the test side stays unseen."""
    bucket = F.pmod(F.col(subject), F.lit(SPLIT_BUCKETS))
    return train.filter(bucket != VALIDATION_BUCKET), train.filter(bucket == VALIDATION_BUCKET)


def encoder(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """One-hot of every category seen in training plus the numeric columns, as one vector.

    The indexer puts unseen and missing values last, and that slot is dropped: they are zero everywhere.
    """
    stages = []
    if categorical:
        index = [f"{c}__index" for c in categorical]
        hot = [f"{c}__hot" for c in categorical]
        stages += [
            StringIndexer(inputCols=list(categorical), outputCols=index, handleInvalid="keep",
                          stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        ]
        numeric = [*numeric, *hot]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=list(numeric), outputCol="features")])


def vector_names(df: DataFrame, column: str = "features") -> list[str]:
    """Slot names of an assembled vector, from its metadata."""
    meta = df.schema[column].metadata.get("ml_attr", {})
    slots = [a for group in meta.get("attrs", {}).values() for a in group]
    if slots:
        return [a.get("name", str(a["idx"])) for a in sorted(slots, key=lambda a: a["idx"])]
    return [str(i) for i in range(meta.get("num_attrs", 0))]


def median_baseline(train: DataFrame, test: DataFrame, label: str = "label", out: str = "prediction") -> DataFrame:
    median = quantile_values(train, [label], {"m": 0.5})[label]["m"]
    return test.withColumn(out, F.lit(median))


def ridge(train: DataFrame, alpha: float = RIDGE_ALPHA, label: str = "label", features: str = "features"):
    """Least squares with penalty alpha * |w|^2: in closed form up to NORMAL_SLOTS slots, by gradient steps beyond.

    The normal solver scales the label by its deviation and the loss by the rows, hence the factor.
    """
    slots = len(vector_names(train, features))
    if slots > NORMAL_SLOTS:
        return ridge_by_gradients(train, slots, alpha, label, features)
    s = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("sd")).first()
    return LinearRegression(
        featuresCol=features, labelCol=label, elasticNetParam=0.0, standardization=False,
        regParam=alpha * s["sd"] / s["n"], solver="normal").fit(train)


def boosted_trees(trees: int = TREES, rate: float = LEARNING_RATE, depth: int = DEPTH,
                  label: str = "label", features: str = "features") -> GBTRegressor:
    """Trees under squared loss; those under the Tweedie loss are in ``boost``."""
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=trees, stepSize=rate,
                        maxDepth=depth, seed=SEED)


def tweedie(power: float = TWEEDIE_POWER, regularisation: float = 0.0,
            label: str = "label", features: str = "features") -> GeneralizedLinearRegression:
    """Log-linear model under the Tweedie likelihood."""
    return GeneralizedLinearRegression(
        featuresCol=features, labelCol=label, family="tweedie", variancePower=power, linkPower=0.0,
        regParam=regularisation)


def tree_grid(depths=GRID_DEPTHS, rates=GRID_RATES, powers=GRID_POWERS) -> list[Setting]:
    """The 27 settings of the original search."""
    return [Setting(*s) for s in product(depths, rates, powers)]


def tree_search(train: DataFrame, validation: DataFrame, names: Sequence[str], grid: Sequence[Setting],
                trees: int = SEARCH_TREES) -> tuple[DataFrame, Setting]:
    """``(setting, parameters, mae_log, mae_days, best_trees, best_mae_log)`` by error, and the best setting.

    All settings are fitted together and scored after every number of trees: errors are those of all ``trees``, and the
    number with the least error stands beside them. The curve has one row for each setting and number of trees.
    """
    spark = train.sparkSession
    curve = error_curve(validation, boost(train, names, grid, trees)).collect()
    by_setting = [sorted((r for r in curve if r["setting"] == i), key=lambda r: r["trees"]) for i in range(len(grid))]
    rows = []
    for i, own in enumerate(by_setting):
        least = min(own, key=lambda r: (r["mae_log"], r["trees"]))
        rows.append((i, grid[i].label(), own[-1]["mae_log"], own[-1]["mae_days"], least["trees"], least["mae_log"]))
    table = spark.createDataFrame(
        rows, "setting int, parameters string, mae_log double, mae_days double, best_trees int, best_mae_log double")
    best = min(rows, key=lambda r: (r[2], r[0]))
    return table.orderBy("mae_log", "setting"), grid[best[0]]


def tweedie_grid(estimator: GeneralizedLinearRegression, powers=GRID_POWERS, penalties=(0.0, 0.01, 0.1)) -> list[dict]:
    return (
        ParamGridBuilder().addGrid(estimator.variancePower, list(powers))
        .addGrid(estimator.regParam, list(penalties)).build()
    )


def search(estimator: Estimator, grid: list[dict], train: DataFrame, validation: DataFrame,
           label: str = "label", parallelism: int = 4) -> tuple[DataFrame, dict]:
    """Fit every setting, score it on the validation side, and return (table by error, best setting).

    Each fit is a Spark job over the whole training side; ``parallelism`` fits share the cluster.
    """
    spark = train.sparkSession
    train, validation = train.persist(), validation.persist()

    def score(i: int) -> tuple:
        setting = grid[i]
        scored = estimator.fit(train, setting).transform(validation)
        y, p = F.col(label), F.col("prediction")
        row = scored.agg(
            F.avg(F.abs(y - p)).alias("log"),
            F.avg(F.abs(F.expm1(y) - F.expm1(F.greatest(p, F.lit(0.0))))).alias("days")).first()
        return i, ", ".join(f"{k.name}={v}" for k, v in setting.items()), row["log"], row["days"]

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            scores = list(pool.map(inheritable_thread_target(spark)(score), range(len(grid))))
    finally:
        train.unpersist()
        validation.unpersist()
    best = min(scores, key=lambda s: (s[2], s[0]))
    table = spark.createDataFrame(scores, "setting int, parameters string, mae_log double, mae_days double")
    return table.orderBy("mae_log", "setting"), grid[best[0]]


def permutation_importance(
    model: Model, test: DataFrame, id_column: str, names: Sequence[str], label: str = "label",
    features: str = "features", repeats: int = PERMUTATION_REPEATS, seed: int = SEED,
    steps: Sequence[tuple[int, int]] | None = None,
) -> DataFrame:
    """``(feature, importance, std)``: mean increase of the absolute error when a feature is shuffled.

    Rows are numbered in hash order and repeat r pairs row i with row (i * a + b) mod n, a bijection; ``steps`` may name
    the pairs (a, b), a prime to the number of rows.
    One equi-join on the row number brings the partner's vector for all features, and the features
    are swapped in row by row after it; nothing is ranked or sorted per feature.
    """
    # Each row's own error goes with it, so that a slot without effect gives exactly 0.
    scored = model.transform(test).select(
        id_column, label, features, F.abs(F.col(label) - F.col("prediction")).alias("base"))
    paired = paired_rows(scored, id_column, label, features, repeats, seed, steps)
    slots = F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("slot")
    swapped = paired.select(label, "base", "repeat", "own", "other", slots).select(
        label, "base", "repeat", "slot",
        array_to_vector(F.transform(
            F.col("own"), lambda x, i: F.when(i == F.col("slot"), F.get(F.col("other"), F.col("slot"))).otherwise(x)
        )).alias(features))
    errors = model.transform(swapped).groupBy("slot", "repeat").agg(
        F.avg(F.abs(F.col(label) - F.col("prediction")) - F.col("base")).alias("delta"))
    return over_repeats(errors, names)


def tree_permutation_importance(
    model: TreeModel, test: DataFrame, id_column: str, label: str = "label", features: str = "features",
    repeats: int = PERMUTATION_REPEATS, seed: int = SEED,
) -> DataFrame:
    """The same for boosted trees, with the same partners: a slot's change comes from the trees that split on it alone."""
    paired = paired_rows(test.select(id_column, label, features), id_column, label, features, repeats, seed)
    return over_repeats(shuffled_errors(paired, model, label), model.names)


def paired_rows(rows: DataFrame, id_column: str, label: str, features: str, repeats: int, seed: int,
                steps: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Each row ``repeats`` times, with ``repeat``, its slots ``own`` and those of its partner, ``other``."""
    indexed = written(dense_index(rows, [id_column], "__i", seed=seed).drop(id_column), "importance")
    n = indexed.count()
    if n < 2:
        raise ValueError("two rows are needed to shuffle")
    moves = F.array(*[
        F.struct(F.lit(r).alias("repeat"),
                 F.pmod(F.col("__i") * F.lit(a) + F.lit(b), F.lit(n)).alias("__j"))
        for r, (a, b) in enumerate(steps or _coprime_steps(n, repeats, seed))
    ])
    kept = [c for c in indexed.columns if c not in ("__i", features)]
    moved = indexed.select(*kept, vector_to_array(features).alias("own"), F.explode(moves).alias("m"))
    partner = indexed.select(F.col("__i").alias("__j"), vector_to_array(features).alias("other"))
    return spread(moved.select(*kept, "own", "m.repeat", "m.__j"), "__j").join(spread(partner, "__j"), "__j")


def over_repeats(errors: DataFrame, names: Sequence[str]) -> DataFrame:
    table = F.array(*[F.lit(x) for x in names])
    return errors.groupBy("slot").agg(
        F.avg("delta").alias("importance"), F.stddev_samp("delta").alias("std")
    ).select(F.get(table, F.col("slot")).alias("feature"), "importance", "std").orderBy(
        F.col("importance").desc(), "feature")


def _coprime_steps(n: int, repeats: int, seed: int) -> list[tuple[int, int]]:
    """Multipliers prime to n and offsets; multipliers stay below 2^20 so that i * a fits a long."""
    import math
    import random

    rng = random.Random(seed)
    steps = []
    while len(steps) < repeats:
        a, b = rng.randrange(1, min(n, 1 << 20) + 1), rng.randrange(1, n)
        if math.gcd(a, n) == 1:
            steps.append((a, b))
    return steps


def kept_features(importance: DataFrame, threshold: float = 0.0) -> list[str]:
    """Features above the threshold (action on a one-row-per-feature table)."""
    return [r["feature"] for r in importance.filter(F.col("importance") > threshold).select("feature").collect()]


def select_slots(df: DataFrame, names: Sequence[str], kept: Sequence[str], features: str = "features",
                 out: str = "features") -> DataFrame:
    """Vector of the kept slots only."""
    keep = set(kept)
    index = [i for i, n in enumerate(names) if n in keep]
    values = F.array(*[F.get(vector_to_array(features), F.lit(i)) for i in index])
    return df.withColumn(out, array_to_vector(values))


def save_model(model: PipelineModel | Model, path: str) -> None:
    model.write().overwrite().save(path)
