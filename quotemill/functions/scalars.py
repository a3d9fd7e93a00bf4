"""Scalar expressions. Missing is NULL throughout; a zero divisor gives NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a, b) -> Column:
    return F.try_divide(a, b)


def flag(condition: Column) -> Column:
    """+1 where the condition holds, -1 where it does not or cannot be decided."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(-1))


def truth(condition: Column) -> Column:
    """Two-valued logic for final rules: undecided counts as false."""
    return F.coalesce(condition, F.lit(False))


def clip_above(value: Column, bound: Column) -> Column:
    """Value where it is below the bound, else the bound; a missing bound stays missing."""
    return F.when(value < bound, value).otherwise(bound)


def gap_pct(a: str, b: str) -> Column:
    """Gap between two columns in percent of the first."""
    return div(F.col(a) - F.col(b), F.col(a)) * 100


def dollars(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def percent(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", value)


def to_number(text: Column) -> Column:
    """Numeric value of a text, NULL where it is not a number."""
    return text.try_cast("double")


def truncate_to_int(value: Column) -> Column:
    return value.cast("bigint")


def first_day_years_back(day: Column, years: int) -> Column:
    """January 1st of the year `years` before the given day."""
    return F.make_date(F.year(day) - years, F.lit(1), F.lit(1))
