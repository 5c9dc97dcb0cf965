"""Sets of values that often stand in one basket."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.operators.lookup import join_by_size


def frequent_sets(
    rows: DataFrame,
    per: Sequence[str],
    basket: str,
    item: str,
    percent: int,
    folder: str,
) -> DataFrame:
    """Every set of items that stands in at least ``percent`` (above 0) of the baskets of
    its ``per`` group: ``items`` ascending, ``size``, ``support`` and the group's
    ``baskets``.

    ``rows`` hold one item of one basket each; repeated ones count once. A null item is
    none, though its basket counts; a null basket is a basket.

    Sets grow by one item a level along a prefix tree: two sets that are frequent and
    equal but for their last items make a candidate, and only places of candidates are
    carried on. Baskets with the same frequent items are counted as one from the start, and
    supports are partial sums before their shuffle. A basket's frequent items are held by one
    row; frequent sets multiply places as their number demands. Levels are written below
    ``folder``; there are as many as the largest frequent set has items, and one more.
    """
    spark = rows.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    members = rows.select(*per, basket, item).distinct()
    groups = (
        members.select(*per, basket).distinct().groupBy(*per)
        .agg(F.count(F.lit(1)).alias("baskets"))
    )
    enough = F.col("support") * 100 >= percent * F.col("baskets")

    def supported(places: DataFrame) -> DataFrame:
        sums = places.groupBy(*per, "items").agg(F.sum("n").alias("support"))
        return join_by_size(sums, groups, per).filter(enough)

    groups = stored(groups, "groups")
    known = members.filter(F.col(item).isNotNull())
    single = known.select(*per, F.array(item).alias("items"), F.lit(1).alias("n"))
    frequent = stored(supported(single), "sets1")
    # Places: a frequent set within a basket, and the basket's items that follow it.
    kept = join_by_size(
        known.withColumn("items", F.array(item)), frequent.select(*per, "items"),
        [*per, "items"],
    )
    baskets = (
        kept.groupBy(*per, basket).agg(F.array_sort(F.collect_set(item)).alias("all"))
        .groupBy(*per, "all").agg(F.count(F.lit(1)).alias("n"))
    )
    places = stored(
        baskets.select(*per, "n", "all", F.posexplode("all").alias("place", "one")).select(
            *per, "n", F.array("one").alias("items"),
            F.slice("all", F.col("place") + 2, F.size("all")).alias("rest"),
        ),
        "places1",
    )
    levels, size = [], 1
    while not frequent.isEmpty():
        levels.append(frequent.withColumn("size", F.lit(size)))
        nodes = frequent.select(
            *per, F.slice("items", 1, size - 1).alias("prefix"),
            F.element_at("items", -1).alias("last"),
        )
        later = nodes.withColumnRenamed("last", "next")
        candidates = join_by_size(nodes, later, [*per, "prefix"]).filter("last < next")
        candidates = candidates.select(
            *per, F.concat("prefix", F.array("last", "next")).alias("items")
        )
        longer = places.select(
            *per, "n", "items", "rest", F.posexplode("rest").alias("place", "next")
        ).select(
            *per, "n", F.concat("items", F.array("next")).alias("items"),
            F.slice("rest", F.col("place") + 2, F.size("rest")).alias("rest"),
        )
        size += 1
        grown = stored(join_by_size(longer, candidates, [*per, "items"]), f"grown{size}")
        frequent = stored(supported(grown), f"sets{size}")
        places = join_by_size(grown, frequent.select(*per, "items"), [*per, "items"])
    if not levels:
        return frequent.withColumn("size", F.lit(1))
    return reduce(DataFrame.unionByName, levels)
