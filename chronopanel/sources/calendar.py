"""Calendar tables derived from rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.panel import index_range

# Holidays on a fixed (month, day): fixed values.
FIXED_DAYS = [(1, 1), (7, 4), (12, 25)]
# Holidays counted from Easter Sunday, in days: fixed values.
EASTER_OFFSETS = [-47, -2]
# (month, ISO weekday, occurrence); -1 is the last one: fixed values.
NTH_WEEKDAYS = [(1, 1, 3), (5, 1, -1), (9, 1, 1), (11, 4, 4)]


def easter(year: Column) -> Column:
    """Easter Sunday of a Gregorian year (Gauss's rule)."""
    def div(a: Column, b: int) -> Column:
        return F.floor(a / b)

    century = div(year, 100)
    moon = F.pmod(century - div(century, 4) - div(8 * century + 13, 25) + 19 * (year % 19) + 15, F.lit(30))
    full = moon - div(moon, 28) * (1 - div(moon, 28) * div(29 / (moon + 1), 1) * div(21 - year % 19, 11))
    weekday = (year + div(year, 4) + full + 2 - century + div(century, 4)) % 7
    back = full - weekday
    month = 3 + div(back + 40, 44)
    day = back + 28 - 31 * div(month, 4)
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def is_holiday(day: Column) -> Column:
    """Whether a date is one of the holidays above; plain expressions, no lookup."""
    year, month, dom = F.year(day), F.month(day), F.dayofmonth(day)
    iso = F.weekday(day) + 1
    hit = F.lit(False)
    for m, d in FIXED_DAYS:
        hit = hit | ((month == m) & (dom == d))
    for m, wd, nth in NTH_WEEKDAYS:
        if nth > 0:
            place = F.ceil(dom / 7) == nth
        else:
            place = F.dayofmonth(F.last_day(day)) - dom < 7
        hit = hit | ((month == m) & (iso == wd) & place)
    sunday = easter(year)
    for off in EASTER_OFFSETS:
        hit = hit | (day == F.date_add(sunday, off))
    return hit


def holiday_calendar(span: DataFrame, start: str, end: str) -> DataFrame:
    """One row per day between two date columns of a one-row table: (date, holiday)."""
    days = span.select(F.explode(index_range(start, end, "day")).alias("date"))
    return days.withColumn("holiday", is_holiday(F.col("date")).cast("int"))
