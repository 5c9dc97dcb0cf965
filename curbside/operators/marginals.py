"""Counts by several sets of columns from one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def marginals(
    df: DataFrame,
    columns: Sequence[str],
    sets: Sequence[Sequence[str]],
    measure: str = "ticket_count",
    mask: str = "grouping",
) -> DataFrame:
    """Rows per group of every set of ``columns``, one row for each group.

    ``mask`` tells a subtotal from a null value: its bits say which columns a row is
    summed over, the last column's bit lowest, and a null in a column whose bit is 0 is
    a group of nulls.

    Rows are counted by all columns before they are multiplied by the number of sets,
    so what is expanded is the cells, and a cell with most of the rows is one row per
    task. Both the cells and the groups are counted partially before their shuffles.
    """
    cells = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(measure))
    wanted = [[F.col(c) for c in of] for of in sets]
    sums = cells.groupingSets(wanted, *[F.col(c) for c in columns]).agg(
        F.sum(measure).alias(measure), F.grouping_id().alias(mask)
    )
    return sums.select(mask, *columns, measure)


def summed_over(mask: Column, columns: Sequence[str], column: str) -> Column:
    """Whether rows of :func:`marginals` with this ``mask`` are summed over a column."""
    place = len(columns) - 1 - list(columns).index(column)
    return F.getbit(mask, F.lit(place)) == 1
