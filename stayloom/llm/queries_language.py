"""Query op6. A trained model has no SQL; the forward pass is tested by brute force and the model on held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import load
from .common import held_out
from .language import predict, train


def languages(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language": languages}
ORACLES: dict[str, str] = {}
