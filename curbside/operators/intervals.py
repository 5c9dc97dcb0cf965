"""Joins of dates with the periods they fall in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = 64
OPEN = "9999-12-31"


def _bucket(date: Column, days: int) -> Column:
    return F.floor(F.unix_date(date) / days).cast("int")


def interval_join(
    rows: DataFrame,
    periods: DataFrame,
    keys: Sequence[str],
    at: str,
    begins: str,
    ends: str,
    days: int = DAYS,
    span: tuple[str, str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Each row with the periods of its ``keys`` that hold its date ``at``: from
    ``begins`` to ``ends``, both included, a null end open. Periods may overlap; of
    nulls in keys, ``at`` or ``begins`` none matches.

    Time is cut into buckets of ``days``. A period stands once in every bucket it
    touches, a row in one, and the join is one of equal keys and buckets with the two
    comparisons left over, so it is hashed or sorted like any other and never compares
    a row with periods of another time. ``days`` near the usual length of a period keeps
    both the copies and the comparisons few. ``span``, the first and last date there are
    rows of, bounds the copies of long and open periods; without it those dates are
    looked up. ``how`` is ``inner`` or ``left``.
    """
    bucket = "period_bucket"
    end = F.coalesce(F.col(ends), F.lit(OPEN).cast("date"))
    if span is None:
        dates = rows.agg(F.min(at).cast("string"), F.max(at).cast("string")).first()
        span = (dates[0] or OPEN, dates[1] or OPEN)
    first = F.greatest(F.col(begins), F.lit(span[0]).cast("date"))
    last = F.least(end, F.lit(span[1]).cast("date"))
    touched = (
        periods.filter(F.col(begins).isNotNull() & (end >= F.col(begins)) & (last >= first))
        .withColumn(bucket, F.explode(F.sequence(_bucket(first, days), _bucket(last, days))))
        .select(bucket, *[F.col(c).alias(f"period_{c}") for c in periods.columns])
    )
    dated = rows.withColumn("row_bucket", _bucket(F.col(at), days))
    same = F.col("row_bucket") == F.col(bucket)
    for key in keys:
        same &= F.col(key) == F.col(f"period_{key}")
    inside = (F.col(at) >= F.col(f"period_{begins}")) & (
        F.col(f"period_{ends}").isNull() | (F.col(at) <= F.col(f"period_{ends}"))
    )
    joined = dated.join(touched, same & inside, how)
    others = [c for c in periods.columns if c not in keys]
    return joined.select(*rows.columns, *[F.col(f"period_{c}").alias(c) for c in others])
