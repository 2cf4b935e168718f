"""Numeric expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The year of day 0, days of a year and of a month.
FIRST_YEAR, YEAR_DAYS, MONTH_DAYS = 2023, 365.25, 30


def signed_log(c: Column) -> Column:
    """sign(x) * log(1 + |x|)."""
    return F.signum(c) * F.log1p(F.abs(c))


def clipped(c: Column, low: float, high: float) -> Column:
    """Within [low, high]; null stays null."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def month_of(day: Column) -> Column:
    """Months are 30 days; negative days round down."""
    return F.floor(day / MONTH_DAYS).cast("int")


def age_at(day: int, birth_year: Column, first_year: int = FIRST_YEAR) -> Column:
    return F.lit(first_year + day / YEAR_DAYS) - birth_year
