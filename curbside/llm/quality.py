"""Quality by votes of the nearest labelled documents in a latent-semantic space.

Documents are shares of hashed n-grams of their bytes and of their byte classes, and
of words that repeat the one before. A truncated singular value decomposition of the
labelled sample gives the space; its labelled vectors go to every task, which
multiplies all documents by all of them in blocks and lets the nearest vote, by
their similarity.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import bytes_and_offsets, fold_of, read_table, spans_of_rows
from curbside.llm.ngrams import Grams, labelled_sample, labels_of, shares, table_sums

FOLDS, HELD_OUT = 4, 2
FAMILIES = (Grams(3, 12), Grams(6, 12, "class"), Grams(1, 2, "repeat"))

# Labelled rows of each label in the space, its dimensions, and the votes.
ROWS_PER_LABEL = 1000
DIMENSIONS = 16
NEIGHBOURS = 15
_BLOCK = 512
# Bytes of text that a task looks at together.
_TOGETHER = 1 << 20


@dataclass(frozen=True)
class Space:
    tables: list[np.ndarray]  # for each family, bucket x dimension
    centre: np.ndarray
    vectors: np.ndarray  # labelled documents, of length 1
    labels: np.ndarray
    votes: np.ndarray  # what a vote of each weighs


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _right_factors(x: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """The first right singular vectors, by subspace iteration."""
    draw = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8))
    basis = np.linalg.qr(draw.astype(np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :rank]


def fit(texts: Sequence[bytes], labels: Sequence[int], good_share: float | None = None) -> Space:
    """The space of the sample. A vote weighs so much that both labels count as
    their share of all labels does."""
    sizes = [g.buckets for g in FAMILIES]
    if not len(texts):
        tables = [np.zeros((n, 1), np.float32) for n in sizes]
        return Space(tables, np.zeros(1), np.zeros((0, 1)), np.zeros(0), np.zeros(0))
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    x = np.hstack(shares(raw, offsets, FAMILIES))
    scale = (1 / (x.std(axis=0) + 1e-4)).astype(np.float32)
    middle = x.mean(axis=0)
    factors = _right_factors(np.sqrt(scale) * (x - middle), min(DIMENSIONS, *x.shape))
    table = np.sqrt(scale)[:, None] * factors
    labels = np.array(labels, float)
    own = labels.mean()
    share = own if good_share is None else good_share
    votes = np.where(labels > 0, share / max(own, 1e-3), (1 - share) / max(1 - own, 1e-3))
    return Space(
        np.split(table.astype(np.float32), np.cumsum(sizes)[:-1]),
        middle @ table,
        _unit((x - middle) @ table).astype(np.float32),
        labels,
        votes,
    )


def _nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest of each row, equal ones in their order."""
    found = np.argpartition(-near, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(near, found, 1).min(axis=1)
    # Only where more than k reach the least does the order decide.
    tied = np.flatnonzero((near >= least[:, None]).sum(axis=1) > k)
    found[tied] = np.argsort(-near[tied], axis=1, kind="stable")[:, :k]
    return found


def vote(space: Space, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of the votes for label 1. Neighbours at equal similarity count in the
    order of the sample; where none is similar at all, the sample's share is given."""
    rows = len(offsets) - 1
    if not len(space.labels):
        return np.full(rows, 0.5)
    found = table_sums(raw, offsets, FAMILIES, space.tables) - space.centre
    vectors = _unit(found).astype(np.float32)
    k = min(NEIGHBOURS, len(space.labels))
    out = np.empty(rows)
    base = (space.votes * space.labels).sum() / space.votes.sum()
    for at in range(0, rows, _BLOCK):
        near = vectors[at : at + _BLOCK] @ space.vectors.T
        nearest = _nearest(near, k)
        weight = np.maximum(np.take_along_axis(near, nearest, 1), 0) ** 2 * space.votes[nearest]
        total = weight.sum(axis=1)
        good = (weight * space.labels[nearest]).sum(axis=1)
        out[at : at + _BLOCK] = np.where(total > 0, good / np.maximum(total, 1e-12), base)
    return np.clip(out, 0, 1)


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_label: int = ROWS_PER_LABEL,
) -> Space:
    """The space of at most ``per_label`` labelled rows of either label among those
    to ``learn`` from, a condition on ``key``. Null labels teach nothing."""
    known = labels_of(docs, labels, "quality", learn, id_col)
    sample = labelled_sample(docs, known, per_label, id_col, text_col)
    share = known.agg(F.avg("label")).first()[0]
    return fit([raw for _, raw in sample], [int(label) for label, _ in sample], share)


def quality_of(text: Column, space: Space) -> Column:
    """Score from 0 to 1 of a text; a null text is an empty one."""

    @F.arrow_udf("double")
    def of_batch(column: pa.Array) -> pa.Array:
        raw, offsets = bytes_and_offsets(column)
        scores = [
            vote(space, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for a, b in spans_of_rows(offsets, _TOGETHER)
        ]
        return pa.array(np.concatenate(scores) if scores else np.zeros(0))

    return of_batch.asNondeterministic()(text)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    learn = fold_of(F.col("key"), FOLDS) != HELD_OUT
    space = learn_quality(docs, read_table(spark, sf_dir, "labels"), learn)
    scored = docs.select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        quality_of(F.col("text"), space).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
