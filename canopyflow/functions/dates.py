"""Date helpers; the current day is always an argument, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopyflow.functions.numbers import col


def iso_date(text: Column | str) -> Column:
    """First ten characters as a date, null when they are not a date."""
    return F.try_to_date(F.substring(col(text), 1, 10), "yyyy-MM-dd")


def season_year(date: Column | str) -> Column:
    """September-August season, named by the year of its September."""
    return F.year(F.add_months(col(date), -8))


def season_mid_month(start_year: Column | str, month: Column | str) -> Column:
    """The 15th of ``month`` inside the season that starts in ``start_year``."""
    year = col(start_year) + F.when(col(month) >= 9, 0).otherwise(1)
    return F.make_date(year, col(month), F.lit(15))


def date_grid(first: Column | str, last: Column | str, step_days: int = 10) -> Column:
    """Array of dates from ``first`` to ``last`` every ``step_days`` days."""
    return F.sequence(col(first), col(last), F.make_dt_interval(days=F.lit(step_days)))


def default_period(start: Column | str, end: Column | str, as_of: Column, days: int,
                   max_days: int | None = None) -> tuple[Column, Column]:
    """Fill a missing period from ``as_of``; clamp longer ones to the last year."""
    first = F.coalesce(col(start), F.date_sub(as_of, days))
    last = F.coalesce(col(end), as_of)
    if max_days is not None:
        both = col(start).isNotNull() & col(end).isNotNull()
        too_long = both & (F.date_diff(last, first) > max_days)
        first = F.when(too_long, F.add_months(last, -12)).otherwise(first)
    return first, last
