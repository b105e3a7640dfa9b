"""Query op7. SQL has no tokenizer; the tests compare with the tokenizers library on whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import load
from .tokens import count_tokens


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(load(spark, d, "documents").select("doc_id", "text"), limit=2048).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op7_token_counts": token_counts}
ORACLES: dict[str, str] = {}
