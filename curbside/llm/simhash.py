"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that of two fingerprints at most
``max_bits`` apart one segment differs by one bit at most. Each segment is indexed
whole and with each of its bits as a wildcard, so such two meet under an equal key.
Every meeting is verified by the number of differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import forest, read_table, text_bytes, written
from curbside.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
BITS = 64

# Of a key with more fingerprints than this, blocks of them are compared in tasks
# of their own.
BLOCK = 1024

_CHUNK = 65_536


def fingerprint(raw: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one UTF-8 text, unsigned.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` cuts at the six ASCII
    white-space characters, as asked for.
    """
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle_words:
        starts, ends = starts[: 1 - shingle_words or None], ends[shingle_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), _CHUNK):
        pairs = zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist(), strict=True)
        hashes = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in pairs]
        as_bytes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(as_bytes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_of(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint of a text column as a signed long; null text is empty."""

    @F.arrow_udf("long")
    def of_batch(column: pa.Array) -> pa.Array:
        values = [fingerprint(x.as_buffer().to_pybytes(), shingle_words) for x in column]
        return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())

    return of_batch.asNondeterministic()(text_bytes(text))


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """Shift and width of each segment; none is wider than 32 bits."""
    count = max(2, max_bits // 2 + 1)
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def variants(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``key``, ``segment`` and ``fp`` for each indexed variant of each ``fp``.

    A key is the number of the variant above the segment's remaining bits, so
    keys are exact: no two different variants share one.
    """
    each = []
    for shift, width in _segments(max_bits):
        segment = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(-1, width):
            kept = (1 << width) - 1 - (0 if bit < 0 else 1 << bit)
            key = segment.bitwiseAND(F.lit(kept)).bitwiseOR(F.lit(len(each) << 32))
            each.append(F.struct(key.alias("key"), segment.alias("segment")))
    return prints.select("fp", F.explode(F.array(*each)).alias("v")).select(
        "v.key", "v.segment", "fp"
    )


def _whole_keys(max_bits: int) -> list[int]:
    """Numbers of the variants without a wildcard."""
    numbers, at = [], 0
    for _, width in _segments(max_bits):
        numbers.append(at)
        at += width + 1
    return numbers


def _block_edges(max_bits: int):
    """Edges of a spanning forest of each group of rows with one (key, i, j).

    Rows come sorted, so a group is a run; it holds two blocks at most."""

    def of_group(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fps = np.unique(fps)

        def near(frontier: np.ndarray) -> np.ndarray:
            mask = np.zeros(len(fps), bool)
            for one in fps[frontier]:
                mask |= np.bitwise_count(fps ^ one) <= max_bits
            return mask

        root = forest(len(fps), near)
        linked = root != np.arange(len(fps))
        return fps[linked], fps[root[linked]]

    def of_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch])
            group = rest[["key", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            if len(cuts):
                yield edges_of(rest.iloc[: cuts[-1]], cuts)
                rest = rest.iloc[cuts[-1] :]
        if rest is not None and len(rest):
            group = rest[["key", "i", "j"]].to_numpy()
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            yield edges_of(rest, np.append(cuts, len(rest)))

    def edges_of(rows: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
        fps = rows["fp"].to_numpy().view(np.uint64)
        found, start = [], 0
        for end in ends:
            found.append(of_group(fps[start:end]))
            start = end
        a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
        return pd.DataFrame({"a": a, "b": b})

    return of_partition


def links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly the distinct fingerprints which
    chains of links of ``max_bits`` or fewer bits connect.

    A key of two is verified at once. A key of more is cut into blocks of about
    ``block`` fingerprints; each pair of blocks is a group that returns a spanning
    forest, so many alike make as many edges as fingerprints, not pairs. A
    wildcard key whose fingerprints all have the same bit there adds nothing:
    they have met under the whole segment.
    """
    rows = variants(prints, max_bits)
    whole = F.shiftright("key", 32).isin(_whole_keys(max_bits))
    met = (
        rows.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("fp").alias("a"),
            F.max("fp").alias("b"),
            F.min("segment").alias("low"),
            F.max("segment").alias("high"),
        )
        .filter((F.col("n") > 1) & (whole | (F.col("low") < F.col("high"))))
        .select("key", "n", "a", "b")
    )
    met = written(met, "simhash-keys")
    two = met.filter("n = 2").filter(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    )
    blocks = F.ceil(F.col("n") / block).cast("int")
    large = met.filter("n > 2").select(F.col("key").alias("key_"), blocks.alias("blocks"))
    pairs = (
        rows.join(large, F.col("key") == F.col("key_"))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp"
        )
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )
    many = pairs.mapInPandas(_block_edges(max_bits), "a long, b long")
    return two.select("a", "b").union(many)


def near_duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """:func:`near_duplicates` with the columns named in ``carry`` and with ``root``, one
    of a group's fingerprints, which names the group even where no row has an id."""
    prints = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            fingerprint_of(F.col(text_col), shingle_words).alias("fp"),
            *carry,
        ),
        "simhash-prints",
    )
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = written(distinct, "simhash-distinct")
    roots = components(links(distinct.select("fp"), max_bits))
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = (
        classes.select(F.col("fp").alias("fp_"), F.col("root").alias("root_"))
        .join(smallest, F.col("root_") == F.col("root"))
        .select("fp_", "component_id", "root")
    )
    return prints.join(of_fp, F.col("fp") == F.col("fp_")).select(
        "doc_id", "fp", "component_id", "root", *carry
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``doc_id``, ``fp`` (signed long) and ``component_id`` of every row.

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows are returned as often as they come. A null id is returned as null and is
    nobody's smallest id; the component of such rows alone is null. Other columns
    are not looked at. An empty table gives an empty one.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, shingle_words, max_bits)
    return groups.select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    fingerprint_text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", fingerprint_text, "component_id")
