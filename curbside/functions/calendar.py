"""Issue dates, fiscal years and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbside.schema import ISSUE_DATE_FORMAT


def issue_date_of(text: Column) -> Column:
    """The date in text like ``09/08/2014`` or ``9/8/2014``; null for other text."""
    return F.try_to_date(text, ISSUE_DATE_FORMAT)


def fiscal_year_of(date: Column) -> Column:
    """The fiscal year of a date: Jul 1 to Jun 30, named for the year it ends in."""
    return F.year(F.add_months(date, 6))


def season_of(month: Column) -> Column:
    """Meteorological season of a month number; whatever is left is Winter."""
    return (
        F.when(month.between(3, 5), "Spring")
        .when(month.between(6, 8), "Summer")
        .when(month.between(9, 11), "Fall")
        .otherwise("Winter")
    )
