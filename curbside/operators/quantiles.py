"""Exact quantiles of groups of any size by passes over ever finer histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbside.operators.lookup import join_by_size

DIGIT = 16
_BITS = {"tinyint": 16, "smallint": 16, "int": 32, "date": 32, "bigint": 64}


def exact_quantiles(
    df: DataFrame,
    per: Sequence[str],
    value: str,
    percents: Sequence[int],
    folder: str,
    weight: str | None = None,
) -> DataFrame:
    """``percent`` and its ``value`` in each ``per`` group: the smallest value that at
    least that share of the group's non-null values does not exceed (0: the smallest).

    Where rows stand for several values, ``weight`` names the column that says how many,
    at least one. Values are whole numbers or dates. Each pass counts the next 16 bits of the values
    that share the bits found before, and keeps the part its rank falls in: one pass for
    a smallint, two for an int or a date, four for a bigint. No pass sorts values. What
    is shuffled is counts, and a part has at most 65,536 of them, so a group with most
    rows is no larger to any task than another, nor is a value.

    Between passes the parts, one for each group and percent, are written below
    ``folder``. A group without values has no row.
    """
    kind = dict(df.dtypes)[value]
    if kind not in _BITS:
        raise ValueError(f"{value} is of type {kind}, which is no whole number or date")
    number = F.unix_date(value) if kind == "date" else F.col(value)
    times = F.col(weight) if weight else F.lit(1)
    rows = df.select(
        *per, number.cast("bigint").alias("number"), times.cast("bigint").alias("times")
    ).filter("number IS NOT NULL")

    left = _BITS[kind] - DIGIT
    parts = _first(rows, per, percents, left)
    while left:
        path = f"{folder}/{left}"
        parts.write.parquet(path)
        parts = _next(rows, df.sparkSession.read.parquet(path), per, left - DIGIT)
        left -= DIGIT
    found = F.date_from_unix_date(F.col("part").cast("int")) if kind == "date" else F.col(
        "part"
    ).cast(kind)
    return parts.select(*per, "percent", found.alias("value"))


def _counts(rows: DataFrame, per: Sequence[str], left: int) -> DataFrame:
    part = F.shiftright("number", left).alias("part")
    return rows.groupBy(*per, part).agg(F.sum("times").alias("n"))


def _holds_rank() -> Column:
    return (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))


def _within(parts: DataFrame, per: Sequence[str]) -> DataFrame:
    before = F.col("upto") - F.col("n")
    kept = parts.filter(_holds_rank())
    return kept.select(*per, "percent", "part", (F.col("rank") - before).alias("rank"))


def _first(
    rows: DataFrame, per: Sequence[str], percents: Sequence[int], left: int
) -> DataFrame:
    group = Window.partitionBy(*per)
    summed = _counts(rows, per, left).select(
        "*",
        F.sum("n").over(group).alias("size"),
        F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        .alias("upto"),
    )
    percent = F.explode(F.array(*[F.lit(int(p)) for p in sorted(set(percents))]))
    ranked = summed.select("*", percent.alias("percent")).withColumn(
        "rank", F.greatest(F.expr("(size * percent + 99) DIV 100"), F.lit(1))
    )
    return _within(ranked, per)


def _next(rows: DataFrame, parts: DataFrame, per: Sequence[str], left: int) -> DataFrame:
    """The parts 16 bits finer, of which ``left`` bits are then still unknown."""
    parts = parts.withColumnRenamed("part", "whole")
    found = rows.withColumn("whole", F.shiftright("number", left + DIGIT))
    met = join_by_size(found, parts.select(*per, "whole").distinct(), [*per, "whole"])
    keys = [*per, "whole"]
    summed = _counts(met, keys, left).withColumn(
        "upto",
        F.sum("n").over(
            Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    return _within(join_by_size(summed, parts, keys), per)
