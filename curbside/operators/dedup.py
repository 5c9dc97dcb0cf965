"""Deterministic deduplication on a key."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared_columns(order: Sequence[str], keep: Collection[str] | None) -> list[str]:
    """The part of ``order`` that decides about the columns to ``keep``."""
    wanted = [c for c in order if keep is None or c in keep]
    return list(order[: order.index(wanted[-1]) + 1]) if wanted else []


def keep_first(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    keep: Collection[str] | None = None,
) -> DataFrame:
    """One row per key: the first in ``order``, ascending with nulls first.

    The survivor is ``min(struct(order))``. A struct compares field by field
    with nulls lowest, so this is the row a sorted window would number 1, but it
    is an aggregate: each map task sends on one row per key it saw, and a key
    with very many copies never gathers in one task.

    ``keep`` names the columns wanted beside the keys. The first fields of the
    smallest struct do not depend on the later ones, so the order is cut after
    the last column kept and the rest is neither read nor shuffled.
    """
    wanted = [c for c in order if keep is None or c in keep]
    if not wanted:
        return df.select(*keys).distinct()
    compared = compared_columns(order, keep)
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*compared)).alias("survivor"))
        .select(*keys, *[F.col(f"survivor.{c}").alias(c) for c in wanted])
    )
