"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of local scores, one for each list of dimensions. First every
block of rows gathers its best entries of each list; the k-th best total among them
is a cutoff that no result can be below. Spread evenly below the lists' tops it gives
each list a threshold: a row under all of them cannot reach the cutoff. Second, all
entries at or above a threshold are collected. Third, what is still unknown of the
rows that can reach the cutoff is resolved exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbside.llm.common import read_table, written

TOP = 5
QUERY_STEP = 50
SCALE = 256

# Lists a score is made of, and the entries of each that a block gathers first.
LISTS = 2
LEADERS = 32

ROW_BLOCK, QUERY_BLOCK = 512, 1024


def _usable(vector: Column) -> Column:
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def whole_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """``vec_id`` and ``v``, the components as floor(scale * x) in whole numbers, of
    the rows that take part, equal rows once."""
    usable = vectors.filter(_usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    whole = F.transform(
        F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")
    )
    return usable.select(
        F.col(id_col).cast("long").alias("vec_id"), whole.alias("v")
    ).dropDuplicates()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _local_scores(queries: np.ndarray, rows: np.ndarray, lists: int) -> list[np.ndarray]:
    """Scores by list, query by row, in whole numbers. Doubles hold them exactly
    below 2 ** 53; beyond that 64-bit products are summed."""
    dims = rows.shape[1]
    widest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * dims
    cuts = np.linspace(0, dims, min(lists, dims) + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        q, x = queries[:, a:b], rows[:, a:b]
        if widest < 2**53:
            out.append((q.astype(float) @ x.astype(float).T).astype(np.int64))
        else:
            out.append(q @ x.T)
    return out


GATHERED = "query_id long, vec_id long, total long, tops array<long>"


def _gatherer(top: int, lists: int):
    """Phase 1 in one pair of blocks: of the leaders of each list the best in total,
    and the largest local score of each list."""

    def gather(queries: pa.Table, rows: pa.Table) -> pa.Table:
        qid, vid = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
        ids, vecs, totals, tops = [], [], [], []
        if len(qid) and len(vid):
            local = _local_scores(_matrix(queries["v"]), _matrix(rows["v"]), lists)
            own = qid[:, None] == vid[None, :]
            low = np.iinfo(np.int64).min // 4
            for s in local:
                s[own] = low
            total = np.where(own, low, sum(local))
            count = min(LEADERS, len(vid))
            led = np.zeros(total.shape, bool)
            for s in local:
                leaders = np.argpartition(-s, count - 1, axis=1)[:, :count]
                np.put_along_axis(led, leaders, True, axis=1)
            ranked = np.where(led & ~own, total, low)
            best = np.argsort(-ranked, axis=1, kind="stable")[:, :top]
            for i in range(len(qid)):
                found = [j for j in best[i].tolist() if ranked[i, j] > low]
                if not found:
                    continue
                top_of = [int(s[i].max()) for s in local]
                ids += [qid[i]] * len(found)
                vecs += vid[found].tolist()
                totals += ranked[i, found].tolist()
                tops += [top_of, *[None] * (len(found) - 1)]  # once for the block
        return pa.table(
            {
                "query_id": pa.array(ids, pa.int64()),
                "vec_id": pa.array(vecs, pa.int64()),
                "total": pa.array(totals, pa.int64()),
                "tops": pa.array(tops, pa.list_(pa.int64())),
            }
        )

    return gather


COLLECTED = "query_id long, vec_id long, known long, missing array<int>"


def _collector(lists: int):
    """Phase 2 in one pair of blocks: rows with an entry at or above its list's
    threshold, the sum of those entries, and the lists that are missing."""

    def collect(queries: pa.Table, rows: pa.Table) -> pa.Table:
        qid, vid = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
        q_at, r_at = np.zeros(0, int), np.zeros(0, int)
        known, missing = np.zeros(0, np.int64), []
        if len(qid) and len(vid):
            local = _local_scores(_matrix(queries["v"]), _matrix(rows["v"]), lists)
            least = _matrix(queries["least"])
            cutoff = queries["cutoff"].to_numpy()[:, None]
            sent = [s >= least[:, i : i + 1] for i, s in enumerate(local)]
            # A local score that isn't sent is below its threshold.
            most = sum(
                np.where(e, s, least[:, i : i + 1] - 1)
                for i, (s, e) in enumerate(zip(local, sent, strict=True))
            )
            keep = np.logical_or.reduce(sent) & (most >= cutoff) & (qid[:, None] != vid[None, :])
            q_at, r_at = np.nonzero(keep)
            entries = np.stack([e[q_at, r_at] for e in sent], axis=1)
            values = np.stack([s[q_at, r_at] for s in local], axis=1)
            known = np.where(entries, values, 0).sum(axis=1)
            missing = [np.flatnonzero(~e).tolist() for e in entries]
        return pa.table(
            {
                "query_id": pa.array(qid[q_at], pa.int64()),
                "vec_id": pa.array(vid[r_at], pa.int64()),
                "known": pa.array(known, pa.int64()),
                "missing": pa.array(missing, pa.list_(pa.int32())),
            }
        )

    return collect


def _in_blocks(df: DataFrame, id_col: str, own: str, own_blocks: int, other: str, blocks: int):
    """Rows with the number of their block, once for each block on the other side."""
    return df.withColumn(
        own, F.pmod(F.xxhash64(id_col), F.lit(own_blocks)).cast("int")
    ).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    top: int = TOP,
    lists: int = LISTS,
    row_block: int = ROW_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's ``top`` best
    rows among ``vectors`` (``vec_id``, ``v``), ties to the smaller id.

    Queries are the rows for which ``is_query`` holds; rows with the query's own id
    are no candidates. Vectors of different lengths are not compared. Fewer
    candidates than ``top`` are all returned; with none, or an empty table, nothing
    is. Scores are exact while they fit 64 bits. Queries and rows meet in pairs of
    blocks; nothing is sent to all tasks or to the driver but two counts.
    """
    vectors = written(vectors.withColumn("dims", F.size("v")), "whole-vectors")
    # Under columns of their own, for both sides of a cogroup come from one table.
    queries = vectors.filter(is_query).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("v"), F.col("dims").alias("dims")
    )
    row_blocks = max(1, -(-vectors.count() // row_block))
    query_blocks = max(1, -(-queries.count() // query_block))
    keys = ["dims", "row_block", "query_block"]
    rows = _in_blocks(vectors, "vec_id", "row_block", row_blocks, "query_block", query_blocks)

    def dealt(some: DataFrame) -> DataFrame:
        return _in_blocks(some, "query_id", "query_block", query_blocks, "row_block", row_blocks)

    gathered = written(
        dealt(queries)
        .groupBy(*keys)
        .cogroup(rows.groupBy(*keys))
        .applyInArrow(_gatherer(top, lists), GATHERED),
        "gathered",
    )
    # The k-th best total is a score some rows have: what can't reach it is out.
    best = Window.partitionBy("query_id").orderBy(F.desc("total"), "vec_id")
    cutoff = (
        gathered.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= top)
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("cutoff"))
    )
    tops = (
        gathered.select("query_id", F.posexplode("tops").alias("list", "local"))
        .groupBy("query_id", "list")
        .agg(F.max("local").alias("local"))
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list(F.struct("list", "local"))).alias("tops"))
        .select("query_id", F.col("tops.local").alias("tops"))
    )
    # With fewer than k so far any score will do.
    low = F.lit(-(2**60))
    sum_of_tops = F.aggregate("tops", F.lit(0).cast("long"), lambda a, x: a + x)
    slack = F.ceil((sum_of_tops - F.col("cutoff")) / F.size("tops"))
    least = F.when(
        F.col("n") >= top, F.transform("tops", lambda x: x - F.col("slack"))
    ).otherwise(F.transform("tops", lambda _: low))
    thresholds = (
        cutoff.join(tops, "query_id")
        .withColumn("slack", slack.cast("long"))
        .select(
            "query_id",
            least.alias("least"),
            F.when(F.col("n") >= top, F.col("cutoff")).otherwise(low).alias("cutoff"),
        )
    )
    with_cutoff = queries.join(thresholds, "query_id")
    collected = written(
        dealt(with_cutoff)
        .groupBy(*keys)
        .cogroup(rows.groupBy(*keys))
        .applyInArrow(_collector(lists), COLLECTED),
        "collected",
    )
    # Phase 3: the lists that are missing, from the two vectors themselves.
    complete = collected.filter(F.size("missing") == 0).select(
        "query_id", "vec_id", F.col("known").alias("score")
    )
    parts = F.least(F.lit(lists), F.size("v"))

    def edge(number: Column) -> Column:
        return F.floor(number * F.size("v") / parts).cast("int")

    def local(number: Column) -> Column:
        start, end = edge(number), edge(number + 1)
        products = F.zip_with(
            F.slice("v", start + 1, end - start),
            F.slice("q", start + 1, end - start),
            lambda a, b: a * b,
        )
        return F.aggregate(products, F.lit(0).cast("long"), lambda a, x: a + x)

    remaining = (
        collected.filter(F.size("missing") > 0)
        .join(vectors.select("vec_id", "v"), "vec_id")
        .join(queries.select("query_id", F.col("v").alias("q")), "query_id")
        .withColumn("resolved", F.transform("missing", local))
        .select(
            "query_id",
            "vec_id",
            F.aggregate("resolved", F.col("known"), lambda a, x: a + x).alias("score"),
        )
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        complete.unionByName(remaining)
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_inner_products(vectors, F.col("vec_id") % QUERY_STEP == 0)
