"""Query op10. SQL has no byte-pair merging; the tests compare with the tokenizers library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import load
from .bpe import digests


def bpe_digests(spark: SparkSession, d: str) -> DataFrame:
    return digests(load(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op10_bpe": bpe_digests}
ORACLES: dict[str, str] = {}
