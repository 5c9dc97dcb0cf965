"""Frequencies and the most frequent values of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbside.operators.lookup import join_small


def frequency(
    df: DataFrame,
    by: Sequence[str],
    name: str = "ticket_count",
    count_of: str | None = None,
) -> DataFrame:
    """Rows per group or, given ``count_of``, non-null values of that column.

    Counting the grouping column itself lists its null group with 0.
    """
    counted = F.count(F.lit(1) if count_of is None else F.col(count_of))
    return df.groupBy(*by).agg(counted.alias(name))


def _largest_first(measure: str, ties: Sequence[str]) -> list[Column]:
    return [F.col(measure).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in ties]]


def top_k(
    df: DataFrame,
    per: Sequence[str],
    ties: Sequence[str],
    k: int,
    measure: str = "ticket_count",
    rank: str = "rank",
) -> DataFrame:
    """The ``k`` rows of each ``per`` group with the largest measure.

    Equal measures rank by ``ties``, ascending with nulls first. ``row_number``
    under a ``<= k`` filter lets Spark drop all but ``k`` rows per group in each
    task before the shuffle, so a group of any size arrives as a few rows.
    """
    ranked = Window.partitionBy(*per).orderBy(*_largest_first(measure, ties))
    return df.withColumn(rank, F.row_number().over(ranked)).filter(F.col(rank) <= k)


def nested_top_k(
    cells: DataFrame,
    per: str,
    group: str,
    member: str,
    groups: int,
    members: int,
    count_nulls: bool = True,
    measure: str = "ticket_count",
) -> DataFrame:
    """The largest groups of each ``per`` and, within each, the largest members.

    ``cells`` has one row per (per, group, member) with its row count. Group
    totals are summed from the cells, so the tickets are scanned once: both uses
    of the cells share one shuffle. With ``count_nulls`` off, null groups and
    members count 0, as by ``count(column)``. A null group may take a rank but
    is not reported, for no value equals it.

    The broadcast side has at most ``groups`` rows per ``per`` value.
    """

    def counted(column: str) -> Column:
        if count_nulls:
            return F.col(measure)
        return F.when(F.col(column).isNotNull(), F.col(measure)).otherwise(0)

    totals = cells.groupBy(per, group).agg(F.sum(counted(group)).alias("group_count"))
    largest = top_k(totals, [per], [group], groups, "group_count", "group_rank").filter(
        F.col(group).isNotNull()
    )
    within = join_small(cells, largest, [per, group]).withColumn(measure, counted(member))
    return top_k(within, [per, group], [member], members, measure)
