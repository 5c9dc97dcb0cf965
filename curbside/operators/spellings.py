"""Values that are rare spellings of frequent ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(value: Column) -> Column:
    """Hashes of a value and of all it becomes by losing one character: two values that
    differ by one inserted, deleted or replaced character have one in common."""
    places = F.sequence(F.lit(1), F.char_length(value))
    shorter = F.transform(
        places,
        lambda i: F.xxhash64(
            F.concat(F.substring(value, F.lit(1), i - 1), F.substr(value, i + 1))
        ),
    )
    own = F.array(F.xxhash64(value))
    return F.array_distinct(F.when(value == "", own).otherwise(F.concat(own, shorter)))


def spelling_roots(
    counts: DataFrame, value: str, measure: str, folder: str, factor: int = 10
) -> DataFrame:
    """``counts``, one row for each ``value`` with its ``measure``, and for each its
    ``form`` and ``root``.

    A form is the value of largest measure (ties: the smallest) among those one character
    inserted, deleted or replaced away whose measure is at least ``factor`` times as large;
    null if there is none. The root is the last of the forms' forms, or the value itself.
    A null has neither; an empty value is one deletion from those of one character.

    Values meet by hashes of their deletions and only with far more frequent ones, are
    verified by edit distance, and each keeps one form in a partial aggregate, so no list
    of pairs is shuffled. As many values as share a hash are those that differ in that
    one place. Forms grow by ``factor`` from link to link, which bounds the rounds of
    the roots: five for the default. Links are written below ``folder`` in each round.
    """
    if factor < 2:
        raise ValueError("a form must be at least twice as frequent")
    known = counts.filter(F.col(value).isNotNull())
    keyed = known.select(
        F.col(value).alias("rare"), F.col(measure).alias("n"), F.explode(_keys(F.col(value)))
        .alias("key"),
    )
    frequent = keyed.select("key", F.col("rare").alias("other"), F.col("n").alias("other_n"))
    near = (F.col("other_n") >= factor * F.col("n")) & (
        F.levenshtein("rare", "other", 1) == 1
    )
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    links = (
        keyed.join(frequent, "key").filter(near).groupBy("rare").agg(best.alias("best"))
        .select("rare", F.col("best.form").alias("form"))
    )
    spark = counts.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    forms = stored(links, "forms")
    ends = forms.withColumnRenamed("form", "root")
    # Steps a chain can have from a measure of 1 to the largest of 64 bits.
    for done in range(math.ceil(math.log2(math.log(2**63, factor)))):
        beyond = ends.select(F.col("rare").alias("at"), F.col("root").alias("further"))
        moved = ends.join(beyond, F.col("root") == F.col("at"), "left")
        if moved.filter("further IS NOT NULL").isEmpty():
            break
        ends = stored(
            moved.select("rare", F.coalesce("further", "root").alias("root")), f"roots{done}"
        )
    linked = forms.join(ends, "rare").withColumnRenamed("rare", "linked")
    return (
        counts.join(linked, F.col(value) == F.col("linked"), "left")
        .select(*counts.columns, "form", F.coalesce("root", value).alias("root"))
    )
