"""Scans: CSV with a declared schema, Parquet, catalogue tables, and the fallback between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.codemap import normalised_dictionary
from .schemas import TABLES, schema


def read_csv(
    spark: SparkSession,
    path: str,
    table_schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
) -> DataFrame:
    """CSV file or folder of files with a header, matched to the schema by column name.

    The header is read first: files may hold more columns than declared or another order, and a
    declared column that the file lacks becomes NULL. Undeclared columns are text. All files of a folder
    must have one header; a file with another one stops the read, as its values would get wrong names.
    """
    if table_schema is None:
        df = spark.read.csv(path, header=True)
    else:
        declared = T.StructType.fromDDL(table_schema) if isinstance(table_schema, str) else table_schema
        types = {f.name.upper(): f for f in declared.fields}
        header = spark.read.csv(path, header=True).columns
        fields = [T.StructField(types[h.upper()].name, types[h.upper()].dataType) if h.upper() in types
                  else T.StructField(h, T.StringType()) for h in header]
        df = spark.read.csv(path, header=True, schema=T.StructType(fields), timestampFormat=timestamp_format,
                            enforceSchema=False)
        there = {h.upper() for h in header}
        df = df.withColumns({
            f.name: F.lit(None).cast(f.dataType) for n, f in types.items() if n not in there})
        df = df.select(*declared.names)
    return df.select(*columns) if columns else df


def read_table_csv(spark: SparkSession, folder: str, table: str,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """One of the declared clinical tables from ``folder/TABLE.csv``; only named columns are parsed."""
    if table not in TABLES:
        raise KeyError(f"no schema declared for '{table}'")
    return read_csv(spark, f"{folder}/{table}.csv", schema(table), columns)


def describe(df: DataFrame, n: int = 5) -> DataFrame:
    """Print schema, a preview and the row count, and hand the frame on (two actions)."""
    df.printSchema()
    df.show(n)
    print(f"rows: {df.count()}")
    return df


def nullable_doubles(df: DataFrame) -> DataFrame:
    """Integer columns as nullable doubles."""
    return df.withColumns({
        f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)})


def read_first_available(spark: SparkSession, candidates: Sequence[tuple[str, str]],
                         table_schema: T.StructType | str | None = None) -> DataFrame:
    """First ``(format, path)`` that can be opened, e.g. Parquet, then a CSV folder, then a CSV file."""
    problems = []
    for kind, path in candidates:
        try:
            if kind == "parquet":
                return spark.read.parquet(path)
            if kind == "csv":
                return read_csv(spark, path, table_schema)
            raise ValueError(f"unknown format '{kind}'")
        except AnalysisException as error:
            problems.append(f"{path}: {error.getCondition() or error}")
    raise FileNotFoundError("; ".join(problems))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_items(spark: SparkSession, folder: str) -> DataFrame:
    """Item dictionary, normalised for keyword search."""
    return normalised_dictionary(
        spark.read.csv(f"{folder}/D_ITEMS.csv", header=True).withColumn("ITEMID", F.col("ITEMID").try_cast("int")),
        ["LABEL", "CATEGORY", "DBSOURCE"])


def read_lab_items(spark: SparkSession, folder: str) -> DataFrame:
    return normalised_dictionary(
        spark.read.csv(f"{folder}/D_LABITEMS.csv", header=True).withColumn("ITEMID", F.col("ITEMID").try_cast("int")),
        ["LABEL", "CATEGORY", "FLUID"])
