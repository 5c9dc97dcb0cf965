"""How many rows meet a condition, and which part of all rows they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_and_share(
    df: DataFrame, by: Sequence[str], condition: Column, name: str
) -> DataFrame:
    """``<name>_count``, ``ticket_count`` and ``<name>_share`` of each group."""
    count, total = f"{name}_count", "ticket_count"
    return (
        df.groupBy(*by)
        .agg(F.count_if(condition).alias(count), F.count(F.lit(1)).alias(total))
        .withColumn(
            f"{name}_share", F.col(count).cast("double") / F.col(total).cast("double")
        )
    )
