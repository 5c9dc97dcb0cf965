"""The first rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def preview(
    df: DataFrame, keys: DataFrame, per: str, key: str, order: Sequence[Column], rows: int
) -> DataFrame:
    """The first ``rows`` rows of each group by ``key``, nulls last, then ``order``.

    ``keys`` are ``per`` and ``key`` of the same rows. First these two columns alone
    give the key of each group's last row shown; each task passes on ``rows`` keys
    of a group and no more. Then only rows up to that key are read whole and sorted.
    The broadcast side has a row for each group.
    """
    first = Window.partitionBy(per).orderBy(F.col(key).asc_nulls_last())
    shown = (
        keys.select(per, key)
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= rows)
    )
    # The largest key shown, or none where rows without a key are shown too.
    bounds = shown.groupBy(F.col(per).alias("group_shown")).agg(
        F.max(key).alias("last_key"), (F.count(key) < F.count(F.lit(1))).alias("with_nulls")
    )
    near = df.join(
        F.broadcast(bounds),
        F.col(per).eqNullSafe(F.col("group_shown"))
        & (F.col("with_nulls") | (F.col(key) <= F.col("last_key"))),
        "left_semi",
    )
    place = F.row_number().over(
        Window.partitionBy(per).orderBy(F.col(key).asc_nulls_last(), *order)
    )
    return near.withColumn("place", place).filter(F.col("place") <= rows).drop("place")
