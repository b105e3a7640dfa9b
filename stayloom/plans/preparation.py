"""Selected table to encoded training table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DO_NOT_IMPUTE, MEDIAN_IMPUTE, ZERO_IMPUTE
from ..functions.numbers import age_years, capped_age
from ..operators.prepare import MedianImputer, OneHot, cohort_filter, fill_zero, map_category, require
from ..session import written


def prepare(
    df: DataFrame,
    diagnosis_map: DataFrame,
    keep_flag: int = 0,
    cap_age: bool = False,
    fit_on: DataFrame | None = None,
    encode: Sequence[str] = ("DIAGNOSIS", "ADMISSION_TYPE"),
) -> DataFrame:
    """Cohort filter, required columns, imputation, age, category map, one-hot without the first.

    Medians and categories come from the whole table, or from ``fit_on`` (already prepared up to
    imputation, such as the training side) if given.
    """
    rows = require(cohort_filter(df, "EXPIRE_FLAG", keep_flag), ["LOS", "DIAGNOSIS"])
    rows = fill_zero(rows, [c for c in ZERO_IMPUTE if c not in DO_NOT_IMPUTE])
    # Medians, categories and the result read this one stored frame.
    rows = written(rows, "cohort")
    medians = MedianImputer.fit(rows if fit_on is None else fit_on, MEDIAN_IMPUTE)
    rows = medians.transform(rows)
    age = age_years(F.col("ADMITTIME"), F.col("DOB"))
    rows = rows.withColumn("age", capped_age(age) if cap_age else age).drop("DOB", "ADMITTIME")
    rows = map_category(rows, diagnosis_map)
    return OneHot.fit(rows, list(encode), drop_first=True).transform(rows)
