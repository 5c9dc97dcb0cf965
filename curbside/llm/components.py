"""Connected components of an edge table by alternating large and small stars.

Each round is two grouped minima joined back to the edges (Kiveris et al., 2014).
A node with very many neighbours is a partial aggregate on one side and a join
that adaptive execution can split on the other; nothing is gathered per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import written


def _with_smallest(edges: DataFrame) -> DataFrame:
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    smallest = smallest.select(F.col("a").alias("a_"), "m")
    return edges.join(smallest, F.col("a") == F.col("a_")).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    stars = _with_smallest(both).filter("b > a")
    return stars.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges with a > b."""
    stars = _with_smallest(edges)
    beside = stars.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return beside.union(stars.select("a", F.col("m").alias("b"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it can reach, for every node of
    ``edges`` (``a``, ``b``, both long) but the roots themselves.

    Self-loops, repeated edges and either direction are fine; an edge with a null
    end is no edge.
    """
    edges = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = written(edges.distinct(), "edges")
    before = _digest(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)), "stars")
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
