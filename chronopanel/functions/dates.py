"""Date parsing, calendar labels and calendar predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_mdy(x: Column | str) -> Column:
    """``M/d/yyyy`` text to a date; NULL when it does not parse."""
    return F.try_to_timestamp(_c(x), F.lit("M/d/yyyy")).cast("date")


def parse_ymd(x: Column | str) -> Column:
    return F.try_to_timestamp(_c(x), F.lit("yyyy-MM-dd")).cast("date")


def first_token_date(x: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """The date in front of the first blank of a datetime text."""
    return F.try_to_timestamp(F.split(_c(x), " ").getItem(0), F.lit(fmt)).cast("date")


def parse_quarter(x: Column | str) -> Column:
    """``1998 Q2`` to the first day of that quarter."""
    year = F.regexp_extract(_c(x), r"(\d{4})", 1).cast("int")
    quarter = F.regexp_extract(_c(x), r"Q(\d)", 1).cast("int")
    return F.make_date(year, quarter * 3 - 2, F.lit(1))


def week_label(d: Column | str) -> Column:
    """ISO label such as ``2020 W53``; the year is the week-based one."""
    year = F.extract(F.lit("YEAROFWEEK"), _c(d)).cast("string")
    return F.concat(year, F.lit(" W"), F.lpad(F.weekofyear(_c(d)).cast("string"), 2, "0"))


def month_label(d: Column | str) -> Column:
    return F.date_format(_c(d), "yyyy MMM")


def quarter_label(d: Column | str) -> Column:
    return F.concat(F.year(_c(d)).cast("string"), F.lit(" Q"), F.quarter(_c(d)).cast("string"))


def grain_span(text: str) -> tuple[dt.date, dt.date]:
    """First and last day named by ``2004``, ``2004 Q4``, ``2004-11`` or a day."""
    if " Q" in text:
        year, quarter = text.split(" Q")
        first = dt.date(int(year), 3 * int(quarter) - 2, 1)
        months = 3
    elif len(text) == 4:
        first, months = dt.date(int(text), 1, 1), 12
    elif len(text) == 7:
        first, months = dt.date(int(text[:4]), int(text[5:]), 1), 1
    else:
        day = dt.date.fromisoformat(text)
        return day, day
    ahead = first.month - 1 + months
    after = dt.date(first.year + ahead // 12, ahead % 12 + 1, 1)
    return first, after - dt.timedelta(days=1)


def in_span(index: Column | str, start: str | None, end: str | None) -> Column:
    """Inclusive time range at the grain of its end points; None leaves a side open.

    The predicate compares the raw column with constants, so it reaches the scan.
    """
    col, pred = _c(index), F.lit(True)
    if start is not None:
        pred = pred & (col >= F.lit(grain_span(start)[0]))
    if end is not None:
        pred = pred & (col < F.lit(grain_span(end)[1] + dt.timedelta(days=1)))
    return pred


def year_at_least(index: Column | str, year: int) -> Column:
    """``year(index) >= year`` written as a range on the raw column."""
    return _c(index) >= F.lit(dt.date(year, 1, 1))


def in_month(index: Column | str, year: int, month: int) -> Column:
    return in_span(index, f"{year:04d}-{month:02d}", f"{year:04d}-{month:02d}")
