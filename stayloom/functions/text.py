"""Names and text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that become "_" and characters that vanish in a feature name.
TO_UNDERSCORE = " /-"
REMOVED = "()"


def feature_name(name: object) -> str:
    """Feature name of a map entry."""
    table = str.maketrans(dict.fromkeys(TO_UNDERSCORE, "_") | dict.fromkeys(REMOVED))
    return str(name).strip().lower().translate(table)


def feature_name_column(c: Column) -> Column:
    """The same rule on a column of map names."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "[ /-]", "_"), "[()]", "")


def sanitised(df: DataFrame) -> DataFrame:
    """Column names with every character outside letters, digits, ``_`` and blanks replaced by ``_``."""
    names = [re.sub(r"[^\w\s]", "_", c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("two columns have the same sanitised name")
    return df.toDF(*names)


def keyword_flags(df: DataFrame, text: str, flags: dict[str, str]) -> DataFrame:
    """0/1 column per flag: does the whole text match the pattern (any case)?"""
    return df.withColumns({
        name: F.coalesce(F.col(text).rlike(f"(?i){pattern}"), F.lit(False)).cast("int")
        for name, pattern in flags.items()
    })
