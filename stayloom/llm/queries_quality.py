"""Query op3. A trained model has no SQL; its held-out accuracy is tested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import load
from .common import held_out
from .quality import score, train


def quality_of_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, load(spark, d, "labels")), threshold=0.3)
    return scored.select("doc_id", held_out(scored["doc_id"]).alias("held_out"), "score", "predicted")


QUERIES = {"op3_quality": quality_of_documents}
ORACLES: dict[str, str] = {}
