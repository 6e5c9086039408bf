"""Calendar labels of a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postweave.params import DIVISIONS, one_of


def week_of_year(day: Column) -> Column:
    """Full seven-day periods since 1 January, plus one (not the ISO week)."""
    return (F.floor((F.dayofyear(day) - 1) / 7) + 1).cast("int")


def biweek_of_year(day: Column) -> Column:
    """Half the week number, rounded half to even."""
    return F.bround(week_of_year(day) / 2, 0).cast("int")


def calendar_bucket(day: Column, division: str, with_year: bool = False) -> Column:
    """Label of the period ``day`` falls in.

    Months are ``M-YYYY`` and days ``D-M-YYYY`` without zero padding. Week and biweek numbers carry
    no year, so the same week of two years is one bucket; ``with_year`` appends the year. A missing day has
    a null label.
    """
    one_of("division", division, DIVISIONS)
    if division == "month":
        return _dashed(F.month(day), F.year(day))
    if division == "day":
        return _dashed(F.dayofmonth(day), F.month(day), F.year(day))
    number = week_of_year(day) if division == "week" else biweek_of_year(day)
    return _dashed(number, F.year(day)) if with_year else number.cast("string")


def _dashed(first: Column, *others: Column) -> Column:
    parts = [first.cast("string")]
    for other in others:
        parts += [F.lit("-"), other.cast("string")]
    return F.concat(*parts)


def date_text(day: Column) -> Column:
    """A date or timestamp as ``YYYY-MM-DD``."""
    return F.date_format(F.to_date(day), "yyyy-MM-dd")
