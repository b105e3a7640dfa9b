"""Association report, feature selection, outlier removal and the log target."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import log_target
from ..operators import assoc
from ..operators.prepare import outlier_bounds, select_existing, within_bounds
from ..operators.profile import categorical_columns, numeric_columns
from ..session import written


@dataclass(frozen=True)
class Associations:
    """One-row-per-feature tables."""

    numeric: DataFrame
    categorical: DataFrame
    information: DataFrame
    ranking: DataFrame


def association_report(df: DataFrame, target: str = "LOS", exclude: Sequence[str] = ()) -> Associations:
    numbers = [c for c in numeric_columns(df) if c != target and c not in exclude]
    groups = [c for c in categorical_columns(df) if c not in exclude]
    # Stored once with the columns in use, as every test scans it.
    df = written(df.select(target, *numbers, *groups), "associations")
    numeric = assoc.fdr_bh(assoc.spearman_with_target(df, numbers, target))
    categorical = assoc.fdr_bh(assoc.rank_tests(df, groups, target)) if groups else None
    information = assoc.mutual_information(df, numbers, target)
    return Associations(numeric, categorical, information, assoc.combined_ranking(information, numeric))


def select_and_fence(df: DataFrame, wanted: Sequence[str], target: str = "LOS") -> tuple[DataFrame, list[str]]:
    """Wanted columns, rows within the outlier fence, ``{target}_log`` added; and the names not found."""
    selected, missing = select_existing(df, wanted)
    clean = within_bounds(selected, target, *outlier_bounds(selected, target))
    return clean.withColumn(f"{target}_log", log_target(F.col(target))), missing
