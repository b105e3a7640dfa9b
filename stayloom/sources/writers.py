"""Sinks. Every write is done by the executors; no row passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import keep_last
from ..session import written

# Fixed value: text form of every exported timestamp.
TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"

FILES_A_DAY = 8
ANSWER_PARTS = 32


def timestamps_as_text(df: DataFrame) -> DataFrame:
    """All timestamp columns as ``yyyy-MM-dd HH:mm:ss``."""
    return df.withColumns({
        f.name: F.date_format(f.name, TIMESTAMP_TEXT)
        for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))})


def write_csv(df: DataFrame, path: str) -> None:
    """Folder of CSV parts with a header, timestamps as text, no row index."""
    timestamps_as_text(df).write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Create or replace a catalogue table, whose files lie in ``path`` or in the warehouse."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_events_table(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> None:
    """Event table bucketed by id: later joins and aggregates on the id read it without a shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_dated(df: DataFrame, path: str, time: str, day: str = "day") -> None:
    """Events in one folder a day, so that a read for some days leaves the other folders alone.

    Rows of a day are dealt over several tasks by their hash, so a busy day is not one file; rows without a time go to a folder of their own.
    """
    dated = df.withColumn(day, F.to_date(time))
    dealt = dated.repartition(F.col(day), F.pmod(F.xxhash64(*df.columns), F.lit(FILES_A_DAY)))
    dealt.write.mode("overwrite").partitionBy(day).parquet(path)


def append_answers(df: DataFrame, path: str) -> None:
    """Incremental save: new answers are appended, the latest per key is taken on read."""
    df.write.mode("append").parquet(path)


def upsert_answers(df: DataFrame, path: str, key: str, sequence: str, parts: int = ANSWER_PARTS) -> None:
    """Incremental save with one row per key: the latest by ``sequence`` stays, an older one that comes late does not.

    Answers lie in ``parts`` folders by a hash of the key. Only the folders that new keys fall into are read, merged and
    replaced; the others keep their files. ``parts`` must be the same in every load; keys and sequence numbers are not NULL.
    """
    spark = df.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    new = written(keep_last(df.withColumn("part", part), key, sequence), "answers-new")
    touched = [r["part"] for r in new.select("part").distinct().collect()]
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        old = spark.read.schema(new.schema).parquet(path).filter(F.col("part").isin(touched))
        # Written aside first: the folders that are replaced are the ones just read.
        new = written(keep_last(old.unionByName(new), key, sequence), "answers-merged")
    new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
