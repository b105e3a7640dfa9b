"""Corpus pipeline: toxicity, language, near duplicates, mixture and tokens, each stage over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayloom.llm import bpe, language, minhash, mixing, toxicity
from stayloom.session import load, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score stays below one half."""
    model = toxicity.train(docs, load(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.5).filter("predicted = 0").select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits a learned language. ``lang`` stays if the text fits it, else the prediction takes its place."""
    found = language.judge(docs, language.train(docs))
    known = found.filter(F.col("fits") | F.col("lang_fits"))
    return known.withColumn("lang", F.when(F.col("lang_fits"), F.col("lang")).otherwise(F.col("lang_pred"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of five-word similarity 0.8 or more; rows without id stay."""
    found = minhash.near_duplicates(docs, size=5, percent=80)
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """150 % of all words, sources weighing 3, 1, 2 in turn, none above two epochs; repeated documents repeat as rows."""
    return mixing.expand(mixing.mix(docs, share=1.5, epochs=2.0), COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and whether decoding them gives back its text (null counts as empty)."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("tokens", tokenize),
]
ORACLE_SQL = None  # trained models and byte-pair merging have no SQL; the tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
