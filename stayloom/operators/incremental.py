"""Growing category map: which texts are new, batches of them, append and keep the last answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import distinct_text, keep_last
from .ranks import dense_index

# Fixed value: texts per batch.
BATCH_SIZE = 50
ANSWER_SCHEMA = "results array<struct<diagnosis string, category string>>"


def unclassified(df: DataFrame, known: DataFrame, column: str = "DIAGNOSIS", key: str = "diagnosis") -> DataFrame:
    """Distinct trimmed texts that the map does not hold yet.

    Both sides are distinct texts before the anti-join, so no key can hold many rows.
    """
    fresh = distinct_text(df, column).select(F.col(column).alias(key))
    seen = distinct_text(known, key)
    return fresh.join(seen, key, "left_anti")


def batched(texts: DataFrame, key: str = "diagnosis", size: int = BATCH_SIZE) -> DataFrame:
    """Number the texts into batches of exactly ``size`` (the last may be shorter)."""
    indexed = dense_index(texts, [key], "__i")
    return indexed.withColumn("batch", F.floor(F.col("__i") / size)).drop("__i")


def requests(batches: DataFrame, key: str = "diagnosis") -> DataFrame:
    """One row per batch with its texts: groups have the batch size by construction."""
    return batches.groupBy("batch").agg(F.array_sort(F.collect_list(key)).alias("texts"))


def parsed_answers(responses: DataFrame, column: str = "response") -> DataFrame:
    """``(diagnosis, category)`` of JSON answers; answers without a ``results`` list give no row."""
    return (
        responses.select(F.explode(F.from_json(F.trim(column), ANSWER_SCHEMA)["results"]).alias("r"))
        .select("r.diagnosis", "r.category").filter(F.col("diagnosis").isNotNull())
    )


def merged_map(old: DataFrame, new: DataFrame, key: str = "diagnosis", sequence: str = "seq") -> DataFrame:
    """Old and new answers together, the last answer per text by load sequence."""
    return keep_last(old.unionByName(new), key, sequence)
