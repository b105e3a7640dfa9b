"""Feature table of an event folder that grows, one row per id and feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import upsert_answers

PARTS = 16


def feature_sums(value: str, time: str) -> list[Column]:
    """Metrics that can be carried on: what a wide table needs of a feature, and how often it occurred."""
    v = F.col(value)
    return [F.count(F.lit(1)).alias("num"), F.count(v).alias("count"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.max(F.when(v.isNotNull(), F.struct(time, value)))[value].alias("latest")]


def follow(spark: SparkSession, folder: str, schema: str, target: str, state: str, ids: list[str], event: str, time: str,
           value: str, late: str = "30 days") -> DataFrame:
    """Take in all files of ``folder`` that were not yet seen, and return the feature table so far.

    Events with an ``event`` id seen before count once, so files may come twice. Events may come ``late`` by that much against the
    newest ones of earlier runs; older ones can no longer be told from repeated ones and are left out. Totals are kept by Spark in
    the folder ``state``; each run replaces, in ``target``, the folders of the ids that changed. A run that fails is
    taken up again from ``state`` and writes the same totals.
    """
    events = spark.readStream.schema(schema).parquet(folder).withWatermark(time, late).dropDuplicatesWithinWatermark([event])
    totals = events.groupBy(*ids).agg(*feature_sums(value, time))

    def keep(changed: DataFrame, batch: int) -> None:
        keyed = changed.withColumn("key", F.to_json(F.struct(*ids))).withColumn("batch", F.lit(batch))
        upsert_answers(keyed, target, "key", "batch", PARTS)

    query = (
        totals.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True)
        .foreachBatch(keep).start())
    query.awaitTermination()
    return spark.read.parquet(target).drop("key", "batch", "part")
