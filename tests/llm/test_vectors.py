"""Near-duplicate embeddings and exact top-k search against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbside.llm import embeddings
from curbside.llm.embeddings import near_duplicate_vectors, op1_embedding_dedup
from curbside.llm.topk_search import op2_topk, top_inner_products, whole_vectors
from tests.conftest import DATA
from tests.llm.conftest import VECTORS


def plain_links(rows):
    """Of rows (id, vector, label) with usable vectors, ids all different."""
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    same = np.array([[a[2] == b[2] for b in rows] for a in rows])
    linked = (x @ x.T >= 0.98) & same & ~np.eye(len(rows), dtype=bool)
    root = {}
    for i in np.argsort(ids):
        todo = [i]
        while todo:
            j = todo.pop()
            if ids[j] not in root:
                root[ids[j]] = ids[i]
                todo += np.flatnonzero(linked[j]).tolist()
    return {one: (int(n), root[one]) for one, n in zip(ids, linked.sum(axis=1), strict=True)}


def clustered(draw, n, dims=16):
    """Vectors around few centres, at distances on both sides of the threshold."""
    centres = draw.standard_normal((6, dims))
    spread = draw.choice([0.01, 0.05, 0.12, 0.2, 0.5], n)[:, None]
    x = centres[draw.integers(0, 6, n)] + spread * draw.standard_normal((n, dims)) * 0.7
    return (x * draw.uniform(0.1, 10, n)[:, None]).astype(np.float32)


@pytest.mark.parametrize("block", [7, 256])
def test_links_of_clusters(spark, block):
    draw = np.random.default_rng(block)
    x = clustered(draw, 400)
    x[50:90] = x[50]  # equal vectors
    rows = [(int(i), v.tolist(), int(draw.integers(0, 2))) for i, v in zip(draw.permutation(400), x, strict=True)]
    found = near_duplicate_vectors(spark.createDataFrame(rows, VECTORS), block=block).collect()
    want = plain_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert len(found) == 400 and sum(n for n, _ in want.values()) > 400


@pytest.mark.parametrize("least", [10, 1_000])
def test_links_of_vectors_of_several_lengths(spark, monkeypatch, least):
    """Each length as if it were alone, with indexes of their own and without."""
    monkeypatch.setattr(embeddings, "LEAST_INDEXED", least)
    draw = np.random.default_rng(least)
    tables, at = [], 0
    for dims, n in ((16, 120), (5, 80), (24, 30), (1, 3), (70, 2)):
        x = clustered(draw, n, dims)
        x[1] = x[0]
        labels = [0, 0, *draw.integers(0, 2, n - 2)]
        tables.append([(at + i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))])
        at += n
    rows = [row for table in tables for row in table]
    found = near_duplicate_vectors(
        spark.createDataFrame([rows[i] for i in draw.permutation(at)], VECTORS), block=13
    ).collect()
    want = {k: v for table in tables for k, v in plain_links(table).items()}
    assert len(found) == at and all(plain_links(table)[table[0][0]][0] for table in tables)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want


def test_embeddings_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").select(
        "vec_id", "embedding", "label"
    )
    found = op1_embedding_dedup(spark, f"{DATA}/sf0.01").collect()
    want = plain_links([tuple(r) for r in rows.collect()])
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2),
        (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (None, [1.0, 0.0], 1),
        (11, [1.0, 0.0, 0.0], 1), (12, [1e-30, 0.0], 1), (13, [1e30, 1e28], 1),
    ]
    found = near_duplicate_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    linked = {1, 2, 12, 13}
    assert len(found) == len(rows) - 1
    for r in found:
        if r.vec_id in linked:
            assert got[r.vec_id] == (3, 1, r.vec_id == 1)
        else:
            assert got[r.vec_id] == (0, r.vec_id, r.vec_id is not None)
    empty = spark.createDataFrame([], VECTORS)
    assert near_duplicate_vectors(empty).count() == 0
    assert near_duplicate_vectors(spark.createDataFrame([(5, None, 1)], VECTORS)).count() == 1


def plain_top(rows, is_query, top=5):
    want = set()
    for i, q in rows:
        if not is_query(i):
            continue
        scored = sorted((-int(np.dot(q, x)), j) for j, x in rows if j != i)[:top]
        want |= {(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)}
    return want


def test_top_of_the_whole_table(spark):
    table = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    rows = [
        (r.vec_id, np.floor(np.array(r.embedding, float) * 256).astype(np.int64))
        for r in table.collect()
    ]
    found = {tuple(r) for r in op2_topk(spark, f"{DATA}/sf0.01").collect()}
    assert found == plain_top(rows, lambda i: i % 50 == 0)


@pytest.mark.parametrize("n, dims, lists", [(300, 6, 2), (300, 6, 3), (120, 1, 2), (4, 3, 2)])
def test_top_with_ties_and_blocks(spark, n, dims, lists):
    draw = np.random.default_rng(n + dims)
    rows = [(i, draw.integers(-3, 4, dims)) for i in range(n)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, v array<long>")
    found = top_inner_products(
        df, F.col("vec_id") % 3 == 0, lists=lists, row_block=64, query_block=32
    )
    assert {tuple(r) for r in found.collect()} == plain_top(rows, lambda i: i % 3 == 0)


def test_scores_beyond_doubles(spark):
    big = 2**29 + 1
    df = spark.createDataFrame(
        [(0, [big, 1]), (1, [big, 1]), (2, [big, 0])], "vec_id long, v array<long>"
    )
    found = sorted(tuple(r) for r in top_inner_products(df, F.col("vec_id") == 0).collect())
    assert found == [(0, 1, 1, big * big + 1), (0, 2, 2, big * big)]


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0], 1), (0, [1.0], 1), (50, None, 1), (1, [float("nan")], 1), (None, [9.0], 1),
            (2, [None], 1), (3, [-0.001], 1), (100, [], 1)]
    df = spark.createDataFrame(rows, VECTORS)
    found = top_inner_products(whole_vectors(df), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 3, -256)]
    assert top_inner_products(whole_vectors(df.limit(0)), F.col("vec_id") == 0).count() == 0
