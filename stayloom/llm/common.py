"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import written

WORD = r"[^\x20\x09-\x0D]+"
HELD_OUT_MOD = 5
BATCH_BYTES = 1024 * 1024


def give_back() -> None:
    """Return freed memory of a Python worker to the machine, Arrow's and the C library's: workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches, which returns its memory once the last batch is done: idle workers then hold no tables.

    Cycles are looked for first, else what they hold stays. A worker takes turns with all others of its executor, so none is ever ended.
    """

    @functools.wraps(work)
    def wrapped(batches: Iterator) -> Iterator:
        yield from work(batches)
        gc.collect()
        give_back()

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of at most BATCH_BYTES (or one text), so that workers stay small.

    A setting of the session, read when a plan is made. Every operator of this subpackage that ships texts sets it to the same
    value and leaves it so: its result is planned only after it has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id as text is divisible by five. Rows without an id are held out, so never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % HELD_OUT_MOD == 0


def draw(seed: str, *columns: Column) -> Column:
    """Number in [0, 2^60) from a hash of the columns: the same in every run, order and partitioning."""
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def labelled_sample(labels: DataFrame, label: str, docs: DataFrame, per_class: int, seed: str) -> DataFrame:
    """``(doc_id, label)`` of at most ``per_class`` random documents of each class that may be learned from.

    Rows without id or label and held-out ids are left out; of repeated ids the largest label counts. Only ids
    and labels move; a class is cut first within salted parts, so that a hot class is never in one task.
    """
    known = learnable(labels, label, docs).withColumn("draw", draw(seed, F.col("doc_id"))).withColumn("part", F.col("draw") % 64)
    return first_rows(known, "label", per_class).select("doc_id", "label")


def learnable(labels: DataFrame, label: str, docs: DataFrame) -> DataFrame:
    """``(doc_id, label)`` of the documents that may be learned from, one row each."""
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    return (
        labels.select("doc_id", F.col(label).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .join(ids, "doc_id", "left_semi")
    )


def class_sizes(labels: DataFrame, label: str, docs: DataFrame) -> dict:
    """Documents of each class among those that may be learned from; held-out labels do not count."""
    return {r["label"]: r["count"] for r in learnable(labels, label, docs).groupBy("label").count().collect()}


def first_rows(keyed: DataFrame, group: str, rows: int) -> DataFrame:
    """The ``rows`` rows of each group with the smallest ``draw``; ``part`` splits the first cut."""
    by_part = W.partitionBy(group, "part").orderBy("draw", "doc_id")
    by_group = W.partitionBy(group).orderBy("draw", "doc_id")
    cut = keyed.withColumn("place", F.row_number().over(by_part)).filter(F.col("place") <= rows)
    return cut.withColumn("place", F.row_number().over(by_group)).filter(F.col("place") <= rows)


def sample_texts(docs: DataFrame, sample: DataFrame, max_chars: int, seed: str) -> DataFrame:
    """``(label, text)`` of the sampled documents: of each class whole documents in random order, until ``max_chars`` characters are reached.

    Lengths play no part: the document that reaches the bound is the last, so a class has at least one.
    """
    chars = F.length("text")
    texts = (
        lookup_join(docs.select("doc_id", "text").filter(F.col("text").isNotNull()), written(sample, "sampled-ids"), ["doc_id"])
        .withColumn("draw", draw(seed, F.col("doc_id"), F.col("text")))
    )
    so_far = W.partitionBy("label").orderBy("draw").rowsBetween(W.unboundedPreceding, -1)
    return written(texts, "sample").withColumn("before", F.coalesce(F.sum(chars).over(so_far), F.lit(0))).filter(
        F.col("before") < max_chars).select("label", "text")
