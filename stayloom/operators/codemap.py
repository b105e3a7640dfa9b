"""Feature maps: code -> feature name, as rows joined to the events."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import feature_name, feature_name_column
from .skew import lookup_join

MAX_DICT_CODES = 100_000


def flatten_map(features: Mapping) -> list[tuple[int, object, str]]:
    """``(map_order, code, feature)`` rows of a flat or grouped map, in map order."""
    rows: list[tuple[int, object, str]] = []
    for name, entry in features.items():
        if isinstance(entry, Mapping):
            leaves = entry.items()
        elif isinstance(entry, list):
            leaves = [(name, entry)]
        else:
            raise ValueError(f"feature '{name}' must map to a list of codes or to a group of features")
        for leaf, codes in leaves:
            rows.extend((len(rows) + i, code, feature_name(leaf)) for i, code in enumerate(codes))
    return rows


def code_map(spark: SparkSession, features: Mapping) -> DataFrame:
    """``(code, feature_name, map_order)``, one row per code; the last feature that lists a code keeps it."""
    rows = flatten_map(features)
    last = {code: (order, name) for order, code, name in rows}
    code_type = T.StringType() if any(isinstance(c, str) for c in last) else T.LongType()
    schema = T.StructType([
        T.StructField("code", code_type, False),
        T.StructField("feature_name", T.StringType(), False),
        T.StructField("map_order", T.IntegerType(), False),
    ])
    return spark.createDataFrame([(c, n, o) for c, (o, n) in last.items()], schema)


def last_wins(map_rows: DataFrame) -> DataFrame:
    """The same rule for a map that is itself a table with ``(code, feature_name, map_order)``."""
    return map_rows.groupBy("code").agg(
        F.max_by("feature_name", "map_order").alias("feature_name"),
        F.max("map_order").alias("map_order"),
    )


def collisions(map_rows: DataFrame) -> DataFrame:
    """Codes claimed by several features: who keeps the code and how many claim it."""
    return (
        map_rows.groupBy("code")
        .agg(
            F.count_distinct("feature_name").alias("n_features"),
            F.max_by("feature_name", "map_order").alias("kept_by"),
        )
        .filter("n_features > 1")
    )


def map_features(features: Mapping) -> list[str]:
    """Features that keep at least one code, in map order: the fixed column list of a wide table."""
    last = {code: name for _, code, name in flatten_map(features)}
    kept = set(last.values())
    return list(dict.fromkeys(name for _, _, name in flatten_map(features) if name in kept))


def resolved_map(spark: SparkSession, features) -> tuple[DataFrame, list[str], bool]:
    """``(map table, feature columns, known to be small)`` of a dict or of ``(map rows, feature names)``."""
    if isinstance(features, Mapping):
        return code_map(spark, features), map_features(features), len(selected_codes(features)) <= MAX_DICT_CODES
    map_rows, names = features
    map_rows = map_rows.withColumn("feature_name", feature_name_column(F.col("feature_name")))
    return last_wins(map_rows), [feature_name(n) for n in names], False


def selected_codes(features: Mapping) -> list:
    return list(dict.fromkeys(code for _, code, _ in flatten_map(features)))


def filter_codes(events: DataFrame, codes: Sequence, code_column: str = "ITEMID") -> DataFrame:
    """Membership filter; pushed to the scan as an IN list when the column is stored."""
    return events.filter(F.col(code_column).isin(list(codes)))


def add_feature_name(
    events: DataFrame, mapping: DataFrame, code_column: str = "ITEMID", how: str = "inner", small: bool = False
) -> DataFrame:
    """Attach ``feature_name``. ``inner`` drops unmapped codes, ``left`` keeps them with NULL.

    A map known to be small is broadcast, any other is measured first.
    """
    lookup = mapping.select(F.col("code").alias(code_column), "feature_name")
    if small:
        return events.join(F.broadcast(lookup), code_column, how)
    return lookup_join(events, lookup, [code_column], how)


# --- building a map from a code dictionary --------------------------------------------------

def normalised_dictionary(df: DataFrame, text_columns: Sequence[str]) -> DataFrame:
    """Upper-case names; NULL or absent text becomes ``""``; text is lower-cased."""
    df = df.toDF(*[c.upper() for c in df.columns])
    text = {
        c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("")
        for c in (name.upper() for name in text_columns)
    }
    return df.withColumns(text)


def keyword_condition(keywords: Sequence[str], columns: Sequence[str]):
    """True where any keyword, read as a case-insensitive regular expression, is found in any column."""
    pattern = "(?i)" + "|".join(f"(?:{k})" for k in keywords)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    return hit


def search_items(df: DataFrame, keywords: Sequence[str], columns: Sequence[str] = ("LABEL",)) -> DataFrame:
    return df.filter(keyword_condition(keywords, columns))


def source_filtered(df: DataFrame, source: str | None, exact: bool = False) -> DataFrame:
    if not source:
        return df
    c = F.col("DBSOURCE")
    return df.filter(c == source) if exact else df.filter(c.contains(source))


def keyword_map(
    dictionary: DataFrame,
    search: Mapping[str, Sequence[str]],
    code: str = "ITEMID",
    columns: Sequence[str] = ("LABEL",),
    source: str | None = None,
) -> DataFrame:
    """Map rows ``(code, feature_name, map_order)`` from a keyword search, in one scan of the dictionary.

    Each dictionary row carries the list of features it matches, so nothing is joined.
    """
    for keywords in search.values():
        for keyword in keywords:
            re.compile(keyword)
    hits = F.array(*[
        F.when(keyword_condition(words, columns),
               F.struct(F.lit(order).alias("map_order"), F.lit(name).alias("feature_name")))
        for order, (name, words) in enumerate(search.items())
    ])
    return (
        source_filtered(dictionary, source)
        .select(F.col(code).alias("code"), F.explode(F.array_compact(hits)).alias("hit"))
        .select("code", "hit.feature_name", "hit.map_order")
    )


def feature_codes(map_rows: DataFrame) -> DataFrame:
    """The code list of every feature as rows, in feature and code order: what a map file holds."""
    return map_rows.select("map_order", "feature_name", "code").distinct().orderBy("map_order", "code")


def code_counts(map_rows: DataFrame, search: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per searched feature: number, sum, first and last of its codes; 0 where none is found.

    Codes are unique in a dictionary, so the counts need no distinct pass.
    """
    wanted = map_rows.sparkSession.createDataFrame([(name,) for name in search], "feature_name string")
    found = map_rows.groupBy("feature_name").agg(
        F.count(F.lit(1)).alias("n_codes"), F.sum("code").alias("code_sum"),
        F.min("code").alias("first_code"), F.max("code").alias("last_code"))
    return wanted.join(found, "feature_name", "left").fillna(0, subset=["n_codes", "code_sum"])


def coverage(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count_if(F.col("n_codes") > 0).alias("n_found"), F.count(F.lit(1)).alias("n_features"))


def labels_of(dictionary: DataFrame, map_rows: DataFrame, code: str = "ITEMID") -> DataFrame:
    """Dictionary rows whose code is in the map."""
    codes = map_rows.select(F.col("code").alias(code)).distinct()
    return lookup_join(dictionary, codes, [code], "left_semi")


def category_counts(dictionary: DataFrame, source: str | None = None) -> DataFrame:
    return (
        source_filtered(dictionary, source, exact=True)
        .groupBy("CATEGORY").agg(F.count(F.lit(1)).alias("n_items"))
    )
