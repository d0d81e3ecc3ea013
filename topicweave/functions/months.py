"""Arithmetic on months written as the integer YYYYMM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names as they stand in publication dates.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def ordinal(month: Column) -> Column:
    """Months since year 0."""
    return F.floor(month / 100).cast("int") * 12 + month % 100 - 1


def from_ordinal(o: Column) -> Column:
    return (F.floor(o / 12).cast("int") * 100 + F.pmod(o, F.lit(12)) + 1).cast("int")


def month_diff(a: Column, b: Column) -> Column:
    """Months from ``b`` to ``a``."""
    return (ordinal(a) - ordinal(b)).cast("int")


def month_shift(month: Column, back: Column | int) -> Column:
    """The month ``back`` months earlier, across any number of years."""
    return from_ordinal(ordinal(month) - back)


def publication_month(year: Column, date: Column) -> Column:
    """YYYYMM from a year and a date such as ``JAN`` or ``JAN 15``; null if the first word is no month."""
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    return (year * 100 + F.try_element_at(names, F.upper(F.split_part(F.trim(date), F.lit(" "), F.lit(1))))).cast("int")


def even_split(total: Column, parts: Column) -> Column:
    """Array of ``parts`` whole numbers that add up to ``total``, the remainder on the last ones; null without parts."""
    big = F.floor(total / parts)
    return F.when(parts > 0, F.transform(F.sequence(F.lit(0), parts.cast("int") - 1), lambda i: (big + (i >= parts - total % parts).cast("int")).cast("int")))
