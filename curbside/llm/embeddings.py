"""Near-duplicate embeddings by product quantisation, without losing a link.

Vectors go to the inverted list of their nearest coarse centre; what is left of them
is coded by subspace. A vector probes every list that can hold one within reach of
it: two unit vectors of cosine c or more are no farther apart than r = sqrt(2 - 2c),
so each lies within r of the plane between their lists' centres. In a list, distances
come from lookup tables; with the error of each code they bound the true distance
from below, so no link is missed, and what passes is measured exactly. Vectors with
another number of components have an index of their own, or one list where few do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import forest, read_table, written
from curbside.llm.components import components

COSINE = 0.98

# Rows the indexes are fitted on, at most; lists, subspaces and codes of each.
SAMPLE_ROWS = 8_192
LISTS = 16
SUBSPACES = 8
CODES = 64

# Numbers of components that are indexed, at most: the commonest, and others with as
# many vectors as this. The rest have one list and are compared exactly.
INDEXES = 8
LEAST_INDEXED = 2_048

# Of a list's members and of its probing vectors, those that one task compares.
BLOCK = 256

_PAIRS = 1 << 17


@dataclass(frozen=True)
class Index:
    centres: np.ndarray
    codebooks: list[np.ndarray]  # for each subspace, code x dimension
    cuts: np.ndarray  # bounds of the subspaces
    reach: float


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _k_means(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[draw.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
    return centres


def fit(sample: np.ndarray, cosine: float = COSINE, seed: int = 9) -> Index:
    """An index of unit vectors; ``sample`` has one row at least."""
    draw = np.random.default_rng(seed)
    centres = np.unique(_k_means(sample, LISTS, draw), axis=0)
    rest = sample - centres[_nearest(sample, centres)]
    cuts = np.unique(np.linspace(0, sample.shape[1], SUBSPACES + 1).astype(int))
    codebooks = [
        _k_means(rest[:, a:b], CODES, draw) for a, b in zip(cuts[:-1], cuts[1:], strict=True)
    ]
    # A little wider than the threshold, against rounding.
    return Index(centres, codebooks, cuts, float(np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6))


def one_list(size: int, cosine: float = COSINE) -> Index:
    """An index of one list and one code, which every pair passes."""
    zero, cuts = np.zeros((1, size)), np.array([0, size])
    return Index(zero, [zero], cuts, float(np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6))


def _coded(index: Index, x: np.ndarray):
    """List, codes and code error of unit vectors, and the lists each must probe:
    its own and, to meet every pair once, those of a higher number within reach."""
    squared = ((x[:, None, :] - index.centres[None]) ** 2).sum(axis=2)
    own = squared.argmin(axis=1)
    rest = x - index.centres[own]
    codes = np.stack(
        [
            _nearest(rest[:, a:b], book)
            for a, b, book in zip(index.cuts[:-1], index.cuts[1:], index.codebooks, strict=True)
        ],
        axis=1,
    ).astype(np.uint8)
    decoded = np.hstack([book[codes[:, s]] for s, book in enumerate(index.codebooks)])
    error = np.linalg.norm(rest - decoded, axis=1)
    between = np.linalg.norm(index.centres[:, None] - index.centres[None], axis=2)
    to_plane = (squared - squared[np.arange(len(x)), own][:, None]) / np.maximum(
        2 * between[own], 1e-12
    )
    lists = np.arange(len(index.centres))
    probes = (to_plane <= index.reach) & (lists > own[:, None]) | (lists == own[:, None])
    return own, codes, error, [np.flatnonzero(p).tolist() for p in probes]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither large nor small ones overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coder(indexes: dict[int, Index], cosine: float):
    @F.arrow_udf("struct<list: int, codes: binary, error: double, probes: array<int>>")
    def of_batch(column: pa.Array) -> pa.Array:
        fields = ["list", "codes", "error", "probes"]
        kinds = [pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.int32())]
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        values: list[list] = [[None] * len(column) for _ in fields]
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            index = indexes.get(size) or one_list(size, cosine)
            own, codes, error, probes = _coded(index, _unit(_matrix(column.take(pa.array(at)))))
            found = [own.tolist(), [c.tobytes() for c in codes], error.tolist(), probes]
            for into, some in zip(values, found, strict=True):
                for i, value in zip(at, some, strict=True):
                    into[i] = value
        arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
        return pa.StructArray.from_arrays(arrays, fields)

    return of_batch.asNondeterministic()


LINKS = "rep long, mark long, links long, other long"


def _comparer(indexes: dict[int, Index], cosine: float):
    """Links between the probing vectors and the members of one block of a list: for
    each vector how many copies it is linked to, and edges of a spanning forest."""

    def of_group(rows: pa.Table) -> pa.Table:
        probing = rows["probing"].to_numpy()
        ids = np.stack([rows["rep"].to_numpy(), rows["mark"].to_numpy()], axis=1)
        copies = rows["copies"].to_numpy()
        x = _unit(_matrix(rows["embedding"]))
        q, m = np.flatnonzero(probing), np.flatnonzero(~probing)
        linked = []
        if len(q) and len(m):
            index = indexes.get(x.shape[1]) or one_list(x.shape[1], cosine)
            here = int(rows["probed"][0].as_py())
            codes = np.stack(
                [np.frombuffer(rows["codes"][int(i)].as_py(), np.uint8) for i in m]
            )
            error = rows["error"].to_numpy()[m]
            rest = x[q] - index.centres[here]
            squared = np.zeros((len(q), len(m)))
            for s, book in enumerate(index.codebooks):
                part = rest[:, index.cuts[s] : index.cuts[s + 1]]
                table = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
                squared += table[:, codes[:, s]]
            near = np.sqrt(squared) <= index.reach + error
            # Within its own list a pair is met from both sides and counted from one.
            same = rows["list"].to_numpy()[q] == here
            first = (ids[q][:, None, 0] < ids[m][None, :, 0]) | (
                (ids[q][:, None, 0] == ids[m][None, :, 0])
                & (ids[q][:, None, 1] < ids[m][None, :, 1])
            )
            a, b = np.nonzero(near & (first | ~same[:, None]))
            for at in range(0, len(a), _PAIRS):
                i, j = q[a[at : at + _PAIRS]], m[b[at : at + _PAIRS]]
                hit = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                linked.append(np.stack([i[hit], j[hit]], axis=1))
        pairs = np.concatenate(linked) if linked else np.zeros((0, 2), int)
        n = len(probing)
        links = np.bincount(pairs[:, 0], weights=copies[pairs[:, 1]], minlength=n)
        links += np.bincount(pairs[:, 1], weights=copies[pairs[:, 0]], minlength=n)
        # Neighbours of each row, to walk the links without a matrix of them.
        ends = np.concatenate([pairs, pairs[:, ::-1]])
        ends = ends[np.argsort(ends[:, 0], kind="stable")]
        begins = np.searchsorted(ends[:, 0], np.arange(n + 1))

        def beside(frontier: np.ndarray) -> np.ndarray:
            mask = np.zeros(n, bool)
            for i in frontier:
                mask[ends[begins[i] : begins[i + 1], 1]] = True
            return mask

        root = forest(n, beside)
        some, child = np.flatnonzero(links), np.flatnonzero(root != np.arange(n))
        none = pa.array([None] * len(some), pa.int64())
        return pa.table(
            {
                "rep": pa.array(np.concatenate([ids[some, 0], ids[child, 0]])),
                "mark": pa.array(np.concatenate([ids[some, 1], ids[child, 1]])),
                "links": pa.array(
                    np.concatenate([links[some].astype(np.int64), np.zeros(len(child), np.int64)])
                ),
                "other": pa.concat_arrays([none, pa.array(ids[root[child], 0])]),
            }
        )

    return of_group


def _usable(embedding: Column) -> Column:
    """Neither null, empty nor zero, and every component a finite number."""
    finite = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return finite & F.exists(embedding, lambda x: x != 0)


def _indexes(distinct: DataFrame, cosine: float) -> dict[int, Index]:
    """Indexes by number of components; none where there are no vectors."""
    most = distinct.groupBy("size").count().orderBy(F.desc("count"), "size").take(INDEXES)
    chosen = [r["size"] for i, r in enumerate(most) if not i or r["count"] >= LEAST_INDEXED]
    indexes = {}
    for size in chosen:
        alike = distinct.filter(F.col("size") == size)
        sample = alike.select("rep", "mark").orderBy(F.xxhash64("rep", "mark"))
        sample = F.broadcast(sample.limit(SAMPLE_ROWS // len(chosen)))
        rows = alike.join(sample, ["rep", "mark"], "left_semi").select("embedding").collect()
        indexes[size] = fit(_unit(np.array([r[0] for r in rows], float)), cosine)
    return indexes


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector.

    Only vectors with the same label that isn't null are compared. Null, empty and
    zero vectors and those with null or non-finite components link with nothing,
    and so do rows without an id, whose component is null. Rows alike in id, label
    and vector are one vector. Vectors with unequal numbers of components are not
    compared. An empty table gives an empty one.

    Equal vectors of a label are compared once and count as often as they come. A
    list with very many members or probing vectors is cut into blocks, so a dense
    group is spread over tasks; each returns counts and a forest, not pairs.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).alias("embedding"),
        F.col(label_col).alias("label"),
    ).dropDuplicates(["vec_id", "label", "embedding"])
    usable = F.coalesce(
        _usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull(),
        F.lit(False),
    )
    lonely = rows.filter(~usable).select(
        "vec_id",
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"),
    )
    comparable = rows.filter(usable)
    distinct = written(
        comparable.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("mark", F.xxhash64("label", "embedding"))
        .withColumn("size", F.size("embedding")),
        "vectors",
    )
    indexes = _indexes(distinct, cosine)
    if not indexes:
        return lonely.withColumn("kept", F.col("vec_id").isNotNull())

    coded = distinct.withColumn("c", _coder(indexes, cosine)(F.col("embedding")))
    coded = coded.select("label", "size", "rep", "mark", "copies", "embedding", "c.*")
    members = coded.select(
        "*", F.col("list").alias("probed"), F.lit(False).alias("probing")
    ).drop("probes")
    queries = coded.select(
        "*", F.explode("probes").alias("probed"), F.lit(True).alias("probing")
    ).drop("probes")
    each = members.unionByName(queries)
    sizes = each.groupBy(
        F.col("label").alias("label_"),
        F.col("size").alias("size_"),
        F.col("probed").alias("probed_"),
    ).agg(
        F.ceil(F.count_if(~F.col("probing")) / block).cast("int").alias("member_blocks"),
        F.ceil(F.count_if("probing") / block).cast("int").alias("query_blocks"),
    )
    placed = each.join(
        sizes,
        (F.col("label") == F.col("label_"))
        & (F.col("size") == F.col("size_"))
        & (F.col("probed") == F.col("probed_")),
    )
    probing = F.col("probing")
    own_blocks = F.when(probing, F.col("query_blocks")).otherwise(F.col("member_blocks"))
    others = F.when(probing, F.col("member_blocks")).otherwise(F.col("query_blocks"))
    own = F.pmod(F.xxhash64("rep", "mark"), own_blocks).cast("int")
    placed = placed.select(
        "label", "size", "probed", "probing", "rep", "mark", "copies", "embedding", "list", "codes",
        "error", own.alias("own"),
        F.explode(F.sequence(F.lit(0), F.greatest(others, F.lit(1)) - 1)).alias("met"),
    ).select(
        "*",
        F.when(probing, F.col("met")).otherwise(F.col("own")).alias("member_block"),
        F.when(probing, F.col("own")).otherwise(F.col("met")).alias("query_block"),
    )
    found = written(
        placed.groupBy("label", "size", "probed", "member_block", "query_block").applyInArrow(
            _comparer(indexes, cosine), LINKS
        ),
        "vector-links",
    )
    counts = (
        found.filter("other IS NULL")
        .groupBy(F.col("rep").alias("rep_"), F.col("mark").alias("mark_"))
        .agg(F.sum("links").alias("links"))
    )
    roots = components(
        found.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    )
    done = (
        distinct.join(
            counts, (F.col("rep") == F.col("rep_")) & (F.col("mark") == F.col("mark_")), "left"
        )
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("label").alias("label_"),
            F.col("embedding").alias("embedding_"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("root", "rep").alias("component_id"),
        )
    )
    linked = comparable.join(
        done, (F.col("label") == F.col("label_")) & (F.col("embedding") == F.col("embedding_"))
    )
    both = linked.select("vec_id", "n_links", "component_id").unionByName(lonely)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return both.withColumn("kept", kept)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))
