"""Scalar columns: elapsed time, ratios, derived vitals, target transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
# Fixed value: mean length of a year in days, used for ages.
YEAR_DAYS = 365.25


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds with their fraction."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def days_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / F.lit(float(DAY_SECONDS))


def hours_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / F.lit(3600.0)


def age_years(at: Column, birth: Column) -> Column:
    """Whole elapsed days over 365.25, cut to an integer (not a calendar-day difference)."""
    return (F.floor(days_between(at, birth)) / F.lit(YEAR_DAYS)).cast("int")


def capped_age(age: Column, limit: int = 89, to: int = 90) -> Column:
    """Birth dates of the very old are shifted by centuries; their age is set to one value."""
    return F.when(age > limit, F.lit(to)).otherwise(age)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def shock_index(heart_rate: Column, systolic: Column) -> Column:
    return ratio(heart_rate, systolic)


def mean_arterial_pressure(systolic: Column, diastolic: Column) -> Column:
    return (systolic + 2 * diastolic) / F.lit(3.0)


def pulse_pressure(systolic: Column, diastolic: Column) -> Column:
    return systolic - diastolic


def numeric(c: Column) -> Column:
    """Text to double; anything unreadable becomes NULL."""
    return c.try_cast("double")


def log_target(y: Column, cap: float | None = None) -> Column:
    """log1p of the target, capped first if asked; NULL stays NULL."""
    y = y.cast("double")
    return F.log1p(y if cap is None else F.when(y.isNotNull(), F.least(y, F.lit(float(cap)))))


def from_log(p: Column) -> Column:
    """Back from log space, negative predictions read as zero."""
    return F.when(p.isNotNull(), F.expm1(F.greatest(p, F.lit(0.0))))
