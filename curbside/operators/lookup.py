"""Adding a small table's columns to rows that share its shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join with a broadcast side whose size the caller has bounded.

    Keys are compared null-safely. A plain equality would have Spark filter
    ``df`` for non-null keys below its aggregation; where ``small`` derives from
    the same aggregate, the two would then no longer be one shuffle.
    """
    renamed = {key: f"small_{key}" for key in keys}
    same = [F.col(key).eqNullSafe(F.col(other)) for key, other in renamed.items()]
    return df.join(
        F.broadcast(small.withColumnsRenamed(renamed)), reduce(lambda a, b: a & b, same)
    ).drop(*renamed.values())


def join_by_size(
    df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join with a side that Spark broadcasts only if it proves to be small. Keys are
    compared null-safely."""
    renamed = {key: f"small_{key}" for key in keys}
    same = [F.col(key).eqNullSafe(F.col(new)) for key, new in renamed.items()]
    return df.join(
        other.withColumnsRenamed(renamed), reduce(lambda a, b: a & b, same), how
    ).drop(*renamed.values())
