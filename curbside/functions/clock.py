"""Twelve-hour clock text such as ``0953A``: parsing, validity and bins.

``try_cast`` turns unreadable hours into null; a plain cast raises in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hour_of(text: Column) -> Column:
    return F.substring(text, 1, 2).try_cast("int")


def meridiem_of(text: Column) -> Column:
    """Everything from the fifth character on, so ``0953AM`` is not taken for A."""
    return F.nullif(F.substring(text, 5, 5), F.lit(""))


def with_parts(tickets: DataFrame) -> DataFrame:
    """Adds ``hour`` and ``am_pm``, null where ``violation_time`` has none."""
    text = F.col("violation_time")
    return tickets.withColumns({"hour": hour_of(text), "am_pm": meridiem_of(text)})


def is_missing(hour: Column, meridiem: Column) -> Column:
    return hour.isNull() | meridiem.isNull()


def is_valid(hour: Column, meridiem: Column) -> Column:
    """On a twelve-hour clock. There is no lower bound on the hour."""
    return (hour <= 12) & meridiem.isin("A", "P")


def label_of(hour: Column, meridiem: Column) -> Column:
    """``9:A`` style label; null when either part is."""
    return F.concat(hour.cast("string"), F.lit(":"), meridiem)


def fold_twelve(hour: Column) -> Column:
    """Hour 12 is hour 0 of the same half day."""
    return F.when(hour == 12, 0).otherwise(hour)


def bin_of(hour: Column, meridiem: Column) -> Column:
    """Four-hour bin of a folded hour; null outside 0 to 11."""

    def within(first: int, last: int, half: str) -> Column:
        return hour.between(first, last) & (meridiem == half)

    return (
        F.when(within(0, 3, "A"), "MidNight")
        .when(within(4, 7, "A"), "Dawn")
        .when(within(8, 11, "A"), "Day")
        .when(within(0, 3, "P"), "Noon")
        .when(within(4, 7, "P"), "Dusk")
        .when(within(8, 11, "P"), "Night")
    )
