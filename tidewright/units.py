"""Ages are integer days from birth; years appear only in input, configuration and display."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_PER_YEAR = 365.25


def years_to_days(years: float) -> int:
    """Half-even, as Spark's rint."""
    return int(round(years * DAYS_PER_YEAR))


def days_to_years(days: float) -> float:
    return days / DAYS_PER_YEAR


def completed_years(days: float) -> int:
    return math.floor(days / DAYS_PER_YEAR)


def years_to_days_col(years: Column) -> Column:
    return F.rint(years * DAYS_PER_YEAR).cast("int")


def completed_years_col(days: Column) -> Column:
    return F.floor(days / DAYS_PER_YEAR)
