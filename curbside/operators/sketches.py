"""Summaries of columns with very many values that can be stored and merged, and the
exact answers a second pass makes of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curbside.operators.lookup import join_by_size
from curbside.operators.topk import top_k

TRACKED = 1_024


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def sketch_states(
    df: DataFrame, per: Sequence[str], columns: Sequence[str], tracked: int = TRACKED
) -> DataFrame:
    """A row for each ``per`` group with a struct for each column: its ``frequent``
    values, a sketch of its ``distinct`` values and ``n``, its non-null values.

    A state is bounded by ``tracked``, whatever the number of values, and is what is
    shuffled: one for each group and task. Values are compared as strings. Nulls are
    no values; a column of nulls has an empty state, and no rows have no states.
    """
    states = [
        F.struct(
            F.expr(f"approx_top_k_accumulate(CAST(`{c}` AS STRING), {tracked})").alias("frequent"),
            F.hll_sketch_agg(_text(c)).alias("distinct"),
            F.count(c).alias("n"),
        ).alias(c)
        for c in columns
    ]
    return df.groupBy(*per).agg(*states)


def merge_states(
    states: DataFrame, per: Sequence[str], columns: Sequence[str], tracked: int = TRACKED
) -> DataFrame:
    """The states of coarser groups, in the form of :func:`sketch_states`. All states
    must have been made with the same ``tracked``."""
    merged = [
        F.struct(
            F.expr(f"approx_top_k_combine(`{c}`.frequent, {tracked})").alias("frequent"),
            F.hll_union_agg(f"{c}.distinct").alias("distinct"),
            F.sum(f"{c}.n").alias("n"),
        ).alias(c)
        for c in columns
    ]
    return states.groupBy(*per).agg(*merged)


def count_error(n: Column | int, tracked: int = TRACKED) -> Column | float:
    """By how much a state's count of a value may be wrong, and what a value may have
    that it does not list: 3.5 / size of the hash map for a frequent-items sketch,
    twice for values it holds but does not report."""
    size = 2 ** math.ceil(math.log2(math.ceil(tracked / 0.75)))
    return n * (2 * 3.5 / size)


def _by_column(columns: Sequence[str], *fields: tuple[str, str]) -> Column:
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.expr(text.format(c=f"`{c}`")).alias(name) for name, text in fields],
        )
        for c in columns
    ]
    return F.inline(F.array(*rows))


def distinct_estimates(
    states: DataFrame, per: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """``column_name`` and about how many values it has (standard error 1.6 %)."""
    estimate = ("distinct_estimate", "hll_sketch_estimate({c}.distinct)")
    return states.select(*per, _by_column(columns, estimate))


def listed_values(
    states: DataFrame, per: Sequence[str], columns: Sequence[str], tracked: int = TRACKED
) -> DataFrame:
    """``column_name``, ``value`` and ``estimate`` of all values the states report."""
    listed = ("listed", f"approx_top_k_estimate({{c}}.frequent, {tracked})")
    each = states.select(*per, _by_column(columns, listed))
    items = each.select(*per, "column_name", F.inline("listed").alias("value", "estimate"))
    return items.filter(F.col("value").isNotNull())


def sketched_top_k(
    df: DataFrame,
    states: DataFrame,
    per: Sequence[str],
    columns: Sequence[str],
    k: int,
    tracked: int = TRACKED,
) -> DataFrame:
    """The exact ``k`` most frequent values of each column in each ``per`` group of
    ``df``, given the states of its rows; ties by value.

    The second pass counts only listed values, at most ``tracked`` a group and column.
    That is the answer where the k-th count exceeds what an unlisted value can have: the
    error of the state, or all that was not counted. Groups for which it does not (near
    uniform values) are counted in full in a third pass; without any, it reads nothing.
    A group is one row a value and task in either shuffle. ``n`` is the number of
    non-null values.
    """
    keys = [*per, "column_name"]
    values = df.select(*per, _by_column(columns, ("value", "CAST({c} AS STRING)"))).filter(
        F.col("value").isNotNull()
    )
    totals = states.select(*per, _by_column(columns, ("n", "{c}.n"))).filter(F.col("n") > 0)
    listed = listed_values(states, per, columns, tracked).drop("estimate")

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("ticket_count"))

    group = Window.partitionBy(*keys)
    largest = top_k(
        counted(join_by_size(values, listed, [*keys, "value"])).withColumn(
            "seen", F.sum("ticket_count").over(group)
        ),
        keys, ["value"], k,
    )
    judged = join_by_size(largest, totals, keys).withColumn(
        "kth", F.max(F.when(F.col("rank") == k, F.col("ticket_count"))).over(group)
    )
    rest = F.col("n") - F.col("seen")
    unlisted = F.least(rest.cast("double"), count_error(F.col("n"), tracked))
    proven = judged.filter((rest == 0) | (F.col("kth") > unlisted))

    same = [F.col(f"open.{key}").eqNullSafe(F.col(f"sure.{key}")) for key in keys]
    sure = proven.select(*keys).distinct()
    unproven = totals.alias("open").join(sure.alias("sure"), same, "left_anti")
    full = top_k(
        counted(join_by_size(values, unproven.drop("n"), keys)), keys, ["value"], k
    )
    columns_out = [*keys, "value", "ticket_count", "rank", "n"]
    return proven.select(*columns_out).unionByName(
        join_by_size(full, totals, keys).select(*columns_out)
    )
