"""What a table holds, column by column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_profile(df: DataFrame, by: str, key: str) -> DataFrame:
    """:func:`column_profile` of one column with hardly two equal values.

    Its values are counted as they are, in a shuffle of the two columns alone.
    """
    values = df.groupBy(by, key).agg(F.count(key).alias("n"))
    return values.groupBy(by).agg(
        F.lit(key).alias("column_name"),
        F.lit(dict(df.dtypes)[key]).alias("data_type"),
        F.sum("n").alias("non_null_count"),
        F.count(key).alias("distinct_count"),
    )


def column_profile(df: DataFrame, by: str) -> DataFrame:
    """Type, non-null count and exact distinct count of every column but ``by``.

    The table is read once. Each row becomes one (position, value) pair per
    column, in which a value stands under its own type, and the pairs are counted
    before they are shuffled, so only distinct values move, and a value found on
    very many rows moves once per task. Leave columns that hardly repeat to
    :func:`key_profile`.
    """
    columns = [(name, kind) for name, kind in df.dtypes if name != by]
    kinds = list(dict.fromkeys(kind for _, kind in columns))
    slots = [f"of_{kind}" for kind in kinds]

    def slot(name: str, kind: str, of: str) -> Column:
        value = F.col(name) if kind == of else F.lit(None).cast(of)
        return value.alias(f"of_{of}")

    pairs = [
        F.struct(F.lit(i).alias("position"), *[slot(name, kind, of) for of in kinds])
        for i, (name, kind) in enumerate(columns)
    ]
    values = (
        df.select(by, F.explode(F.array(*pairs)).alias("pair"))
        .select(by, "pair.*")
        .groupBy(by, "position", *slots)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in slots])

    def labels(of: int) -> Column:
        return F.array(*[F.lit(column[of]) for column in columns])[F.col("position")]

    return (
        values.groupBy(by, "position")
        .agg(
            F.sum(F.when(known, F.col("n")).otherwise(0)).alias("non_null_count"),
            F.count_if(known).alias("distinct_count"),
        )
        .select(
            by,
            labels(0).alias("column_name"),
            labels(1).alias("data_type"),
            "non_null_count",
            "distinct_count",
        )
    )
