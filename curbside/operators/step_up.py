"""Tests of many groups at once with a bounded share of false findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbside.operators.lookup import join_by_size


def step_up(
    df: DataFrame,
    per: Sequence[str],
    evidence: str,
    log_p: Callable[[Column], Column],
    rate: float,
    folder: str,
    slices: int = 200,
) -> DataFrame:
    """``df`` with the ``rank`` of each row's ``evidence`` in its ``per`` group, and
    whether it is ``rejected`` by the step-up rule of Benjamini and Hochberg at ``rate``.

    ``evidence`` is a whole number, larger for smaller p-values, whose logarithm is
    ``log_p`` of it. The rank is the number of rows with that much evidence or more; all
    rows with no less evidence than the weakest that has p <= rate * rank / rows are
    rejected. Null evidence is no test: it has no rank, counts in no group and is not
    rejected.

    Equal evidence is counted first, so ties are one row. A group is then cut into
    ``slices`` ranges of about equally many different values; each is sorted by a task of
    its own and begins where the counts of the ranges above it end, so no task holds a
    group. The bounds of the ranges are approximate, which moves no rank; they are written
    below ``folder``, since they have to be the same when a lost task is run again.
    """
    tallies = (
        df.filter(F.col(evidence).isNotNull()).groupBy(*per, evidence)
        .agg(F.count(F.lit(1)).alias("tied"))
    )
    cuts = [i / slices for i in range(1, slices)]
    bounds = tallies.groupBy(*per).agg(
        F.percentile_approx(evidence, cuts, 10 * slices).alias("bounds")
    )
    bounds.write.parquet(f"{folder}/bounds")
    bounds = df.sparkSession.read.schema(bounds.schema).parquet(f"{folder}/bounds")

    def slice_of(value: Column) -> Column:
        return F.size(F.filter(F.array_distinct("bounds"), lambda b: b < value))

    cut = join_by_size(tallies, bounds, per).withColumn("slice", slice_of(F.col(evidence)))
    cut = cut.drop("bounds")
    group = Window.partitionBy(*per)
    above = group.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*per, "slice").agg(F.sum("tied").alias("size"))
        .select(
            *per, "slice", F.coalesce(F.sum("size").over(above), F.lit(0)).alias("above"),
            F.sum("size").over(group).alias("tests"),
        )
    )
    within = (
        Window.partitionBy(*per, "slice").orderBy(F.desc(evidence))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = join_by_size(
        cut.withColumn("place", F.sum("tied").over(within)), offsets, [*per, "slice"]
    ).withColumn("rank", F.col("above") + F.col("place"))
    passes = log_p(F.col(evidence)) <= F.log(rate * F.col("rank") / F.col("tests"))
    weakest = ranked.groupBy(*per).agg(F.min(F.when(passes, F.col(evidence))).alias("weakest"))
    ranks = join_by_size(ranked.select(*per, evidence, "rank"), weakest, per)
    rejected = F.coalesce(F.col(evidence) >= F.col("weakest"), F.lit(False))
    return join_by_size(df, ranks, [*per, evidence], "left").select(
        *df.columns, "rank", rejected.alias("rejected")
    )


def likelihood_ratio(both: Column, first: Column, second: Column, all_: Column) -> Column:
    """G of the two-by-two table in which ``both`` of ``all_`` rows are in a group of
    ``first`` and in one of ``second`` rows: a double."""
    both, first, second, all_ = (c.cast("double") for c in (both, first, second, all_))

    def term(seen: Column, row: Column, column: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * all_ / (row * column))).otherwise(0.0)

    return 2 * (
        term(both, first, second)
        + term(first - both, first, all_ - second)
        + term(second - both, all_ - first, second)
        + term(all_ - first - second + both, all_ - first, all_ - second)
    )


# A published Chebyshev fit of the complementary error function, lowest power
# first, relative error below 1.2e-7 everywhere.
ERFC_FIT = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def log_p_of_ratio(ratio: Column) -> Column:
    """Natural logarithm of the chance of so large a G with one degree of freedom. It is
    finite where the chance itself is too small for a double."""
    t = 1.0 / (1.0 + 0.5 * F.sqrt(ratio / 2.0))
    fit = F.lit(ERFC_FIT[-1])
    for value in ERFC_FIT[-2::-1]:
        fit = F.lit(value) + t * fit
    return F.log(t) - ratio / 2.0 + fit
