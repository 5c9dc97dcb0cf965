"""Series of days: gaps filled, trends by window frames, values of other years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_days(counts: DataFrame, per: Sequence[str], day: str, measure: str) -> DataFrame:
    """``counts``, a row for each group and day, with 0 for the days between a group's
    first and last that have none. Rows without a day are left out.

    Zeros are added as rows and summed, so no calendar is joined and a null group is
    one like another.
    """
    dated = counts.select(*per, day, measure).filter(F.col(day).isNotNull())
    spans = dated.groupBy(*per).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    every = F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias(day)
    zeros = spans.select(*per, every, F.lit(0).cast("bigint").alias(measure))
    return dated.unionByName(zeros).groupBy(*per, day).agg(F.sum(measure).alias(measure))


def with_trend(
    filled: DataFrame, per: Sequence[str], day: str, measure: str, half: int, trend: str = "trend"
) -> DataFrame:
    """Adds the mean of the measure over the ``half`` days before and after each day and
    the day itself, in whole thousandths rounded down. At the ends of a series the frame
    holds the days there are.

    A group's days, not its rows, are sorted by one task.
    """
    around = Window.partitionBy(*per).orderBy(F.unix_date(day)).rangeBetween(-half, half)
    total, days = F.sum(measure).over(around), F.count(measure).over(around)
    both = filled.select("*", total.alias("frame_total"), days.alias("frame_days"))
    return both.withColumn(trend, F.expr("1000 * frame_total DIV frame_days")).drop(
        "frame_total", "frame_days"
    )


def years_before(value: str, per: Sequence[str], year: str, years: int = 1) -> Column:
    """The value of the group's row so many years earlier, null if there is none: a
    frame of that year alone, not the row before, which may be of an older year."""
    frame = Window.partitionBy(*per).orderBy(year).rangeBetween(-years, -years)
    return F.max(value).over(frame)
