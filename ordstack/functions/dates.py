"""Columns derived from a month-day-year integer such as 1012017 (1 January 2017 as 01012017)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ordstack.functions.numeric import int_div


def parse_mdy(c: Column) -> Column:
    """Date of an ``MMDDYYYY`` integer whose leading zero may be lost; a malformed value raises."""
    c = c.cast("int")
    month_day = int_div(c, 10000)
    return F.make_date(
        c % 10000, int_div(c, 1000000).cast("int"), (month_day % 100).cast("int")
    )


def month_arith(c: Column) -> Column:
    return int_div(c, 1000000).cast("int")


def year_arith(c: Column) -> Column:
    return (c % 10000).cast("int")


def year_offset(d: Column, origin: int = 2016) -> Column:
    return F.year(d) - origin


def month_of(d: Column) -> Column:
    return F.month(d)
