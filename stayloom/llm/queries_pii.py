"""Query op11. A trained model has no SQL; rules and dynamic programming are tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from .pii import KINDS, find, train


def personal_data(spark: SparkSession, d: str) -> DataFrame:
    """Counts and digest are of the base spans, ``spans`` has those that the model adds too."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    found = find(docs, train(docs)).withColumn("ruled", base)
    return found.select(
        "doc_id", *[count("ruled", k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(F.col("ruled")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("ruled")).cast("long").alias("n_added"))


QUERIES = {"op11_personal_data": personal_data}
ORACLES: dict[str, str] = {}
