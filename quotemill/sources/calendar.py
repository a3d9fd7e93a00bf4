"""Trading-session calendars: one row per session date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (month, day) of holidays that fall on the same day every year.
FIXED_HOLIDAYS = ((1, 1), (7, 4), (12, 25))


def weekday_calendar(bars: DataFrame, holidays: Sequence[tuple[int, int]] = FIXED_HOLIDAYS) -> DataFrame:
    """Weekdays between the first and last bar date, less fixed holidays.

    Stands in for an exchange calendar table where none is supplied.
    """
    days = bars.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date")
    )
    day = F.struct(F.month("date"), F.dayofmonth("date"))
    closed = F.lit(False)
    for month, number in holidays:
        closed = closed | (day == F.struct(F.lit(month), F.lit(number)))
    return days.filter((F.weekday("date") < 5) & ~closed)
