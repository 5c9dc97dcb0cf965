"""Hashed byte n-grams of whole texts, vectorised over an Arrow batch.

Texts are walked in slices of fixed size, so a text of any length takes bounded
memory; an n-gram never crosses from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbside.llm.common import fold_of, sums_by_row, text_bytes

SLICE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Classes of bytes: control, blank, digit, upper, lower, other sign, start of a
# character beyond ASCII, continuation.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[:32] = 0
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 4
_CLASS[128:192] = 7
_CLASS[192:] = 6


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def byte_classes(raw: np.ndarray) -> np.ndarray:
    return _CLASS[raw]


_POWERS = np.cumprod(np.full(1024, 0x01000193, np.uint32), dtype=np.uint32)


def _word_pieces(inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about a slice that cut no word."""
    p, n = 0, len(inside)
    while p < n:
        q = min(p + SLICE, n)
        while q < n and inside[q]:
            blank = np.flatnonzero(~inside[q : q + SLICE])
            q = min(n, q + (int(blank[0]) if len(blank) else SLICE))
        yield p, q
        p = q


def repeated_words(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 for each byte of a word that equals the word before it in the text, else 0.
    Words stand between ASCII blanks."""
    out = np.zeros(len(raw), np.uint8)
    inside = _CLASS[raw] != 1
    last = (0, 0, -1)  # hash, length and text of the word before
    for p, q in _word_pieces(inside):
        own = inside[p:q]
        bounds = offsets[(offsets > p) & (offsets < q)] - p
        starts, ends = own.copy(), own.copy()
        starts[1:] &= ~own[:-1]
        ends[:-1] &= ~own[1:]
        starts[bounds], ends[bounds - 1] = own[bounds], own[bounds - 1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        if not len(starts):
            continue
        lengths = ends - starts
        begins = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
        values = (raw[p:q][own] + np.uint32(1)) * _POWERS[place % 1024]
        word = np.add.reduceat(values, begins, dtype=np.uint32)
        text = np.searchsorted(offsets, starts + p, "right")
        same = np.empty(len(word), bool)
        same[0] = (int(word[0]), int(lengths[0]), int(text[0])) == last
        same[1:] = (word[1:] == word[:-1]) & (lengths[1:] == lengths[:-1]) & (text[1:] == text[:-1])
        out[p:q][own] = np.repeat(same, lengths)
        last = (int(word[-1]), int(lengths[-1]), int(text[-1]))
    return out


@dataclass(frozen=True)
class Grams:
    """One family: n-grams of ``order`` of the bytes under ``view``, hashed into
    ``2 ** bits`` buckets."""

    order: int
    bits: int
    view: str = "raw"

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    def seen(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.view == "repeat":
            return repeated_words(raw, offsets)
        return {"raw": lambda x: x, "lower": lower_ascii, "class": byte_classes}[self.view](raw)


def _mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - bits)).astype(np.int32)


def sliced(
    raw: np.ndarray, offsets: np.ndarray, grams: Grams
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi``, their places within the slice, and the bucket of the
    n-gram at each place; places without one have the bucket after the last."""
    ends = offsets[1:]
    seen = grams.seen(raw, offsets)
    for p in range(0, len(raw), SLICE):
        q = min(p + SLICE, len(raw))
        part = seen[p : q + grams.order - 1].astype(np.uint32)
        h = np.full(q - p, grams.order, np.uint32)
        for k in range(grams.order):
            shifted = part[k : k + q - p]
            h[: len(shifted)] = h[: len(shifted)] * np.uint32(0x01000193) + shifted
        ids = _mixed(h, grams.bits)
        near = ends[(ends > p) & (ends < q + grams.order)]
        for k in range(1, grams.order):
            last = near - k
            ids[last[(last >= p) & (last < q)] - p] = grams.buckets
        lo = int(np.searchsorted(offsets, p, "right")) - 1
        hi = int(np.searchsorted(offsets, q, "left"))
        yield lo, hi, np.clip(offsets[lo : hi + 1], p, q) - p, ids


def table_sums(
    raw: np.ndarray, offsets: np.ndarray, families: Sequence[Grams], tables: Sequence[np.ndarray]
) -> np.ndarray:
    """For each text the sum over families of its n-grams' mean table row."""
    rows = len(offsets) - 1
    total = np.zeros((rows, tables[0].shape[1]))
    for grams, table in zip(families, tables, strict=True):
        padded = np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)])
        sums = np.zeros_like(total)
        for lo, hi, places, ids in sliced(raw, offsets, grams):
            sums[lo:hi] += sums_by_row(padded[ids], places)
        total += sums / np.maximum(np.diff(offsets) - grams.order + 1, 1)[:, None]
    return total


def shares(raw: np.ndarray, offsets: np.ndarray, families: Sequence[Grams]) -> list[np.ndarray]:
    """For each family the share of each bucket in each text, one row per text."""
    out = []
    for grams in families:
        counts = np.zeros((len(offsets) - 1, grams.buckets + 1), np.float32)
        for lo, hi, places, ids in sliced(raw, offsets, grams):
            for row in range(lo, hi):
                own = ids[places[row - lo] : places[row - lo + 1]]
                counts[row] += np.bincount(own, minlength=grams.buckets + 1)
        counts = counts[:, :-1]
        out.append(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return out


# Bytes of a text of the sample that reach the driver at most. Of a longer text so many
# pieces are drawn, evenly over all of it, each of whole characters.
SAMPLE_BYTES, SAMPLE_PIECES = 1 << 18, 256


def drawn(text: bytes, size: int = SAMPLE_BYTES, pieces: int = SAMPLE_PIECES) -> bytes:
    """A text as it is or, if longer than ``size``, pieces of it with blanks between."""
    if len(text) <= size:
        return text
    each = max(size // pieces - 1, 1)

    def whole(at: int) -> int:
        while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
            at -= 1
        return at

    starts = [whole(k * (len(text) - each) // (pieces - 1)) for k in range(pieces)]
    return b" ".join(text[a : whole(min(a + each, len(text)))] for a in starts)


def labelled_sample(
    docs: DataFrame, labelled: DataFrame, per_label: int, id_col: str, text_col: str
) -> list[tuple[object, bytes]]:
    """Label and text of at most ``per_label`` rows of each label, by label and id:
    those whose ids hash lowest. ``labelled`` has the columns ``key`` and ``label``.

    Ids are chosen before a text is read. Of a label with many ids only the part
    whose hashes are low is ranked, some twice ``per_label``, however many tasks
    there are; the chosen ids are few enough to broadcast: a fixed number for each
    label. An id that repeats gives one text. Long texts come in pieces (:func:`drawn`).
    """
    draw = F.shiftrightunsigned(F.xxhash64("key"), 11) / float(1 << 53)
    known = labelled.filter("key IS NOT NULL AND label IS NOT NULL").select("key", "label")
    known = known.distinct().withColumn("draw", draw)
    sizes = known.groupBy(F.col("label").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("label").orderBy("draw", "key")
    chosen = (
        known.join(sizes, F.col("label") == F.col("of"))
        .filter(F.col("draw") * F.col("n") < 2 * per_label + 100)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= per_label)
        .select("key", "label")
    )
    texts = docs.select(F.col(id_col).alias("own_key"), text_bytes(F.col(text_col)).alias("raw"))
    found = texts.join(F.broadcast(chosen), F.col("own_key") == F.col("key"))

    @F.arrow_udf("binary")
    def of_batch(column: pa.Array) -> pa.Array:
        return pa.array([drawn(raw) for raw in column.to_pylist()], pa.binary())

    # Of unlike texts with one id the smallest counts, so runs don't differ.
    texts = found.select("key", "label", of_batch("raw").alias("raw"))
    rows = texts.groupBy("key", "label").agg(F.min("raw").alias("raw")).collect()
    return [(r.label, bytes(r.raw)) for r in sorted(rows, key=lambda r: (r.label, r.key))]


def labels_of(
    docs: DataFrame, labels: DataFrame, column: str, learn: Column, id_col: str
) -> DataFrame:
    """``key`` and ``label`` of the ``docs`` that have a 0 or 1 in ``column`` of
    ``labels`` and whose key is to ``learn`` from. Of several labels of one id the
    largest holds. Only ids are read and shuffled."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    known = known.groupBy(F.col("doc_id").alias("key")).agg(F.max(column).alias("label"))
    ids = docs.select(F.col(id_col).alias("own_key"))
    return known.filter(learn).join(ids, F.col("key") == F.col("own_key"), "left_semi")


__all__ = [
    "Grams",
    "byte_classes",
    "fold_of",
    "labelled_sample",
    "labels_of",
    "lower_ascii",
    "shares",
    "sliced",
    "table_sums",
]
