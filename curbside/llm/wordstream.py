"""Words of whole texts as numbers, vectorised over Arrow batches.

A batch is walked in spans of whole texts of a few megabytes. The words of a span are
encoded by the distinct ones among them, so what follows works on small integers and
sees each distinct word's bytes once. Encoding compares bytes, never hashes alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from curbside.llm.common import bytes_and_offsets, spans_of_rows
from curbside.llm.ngrams import lower_ascii

SPAN = 4 << 20

BLANKS = b" \t"
SPACES = b" \t\n\x0b\x0c\r"


def word_bytes(separators: bytes) -> np.ndarray:
    """For each byte whether it belongs to a word, where these separate words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``inside`` begin and end; the bounds of texts end a run."""
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    bounds = np.unique(offsets[(offsets > 0) & (offsets < len(inside))])
    starts[bounds], ends[bounds - 1] = inside[bounds], inside[bounds - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after another."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def strings_of(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive stretches of valid UTF-8 as strings."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))]
    return pa.Array.from_buffers(pa.string(), len(lengths), buffers)


def hashes_of(values: pa.Array) -> np.ndarray:
    """XXH64 of each string."""
    raw = values.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))


@dataclass
class Words:
    """The words of some texts in order: the text of each, its place among the
    ``distinct`` ones, and the byte it starts at."""

    text: np.ndarray
    word: np.ndarray
    starts: np.ndarray
    distinct: pa.Array
    raw: np.ndarray
    offsets: np.ndarray


def words_of(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Words are the runs of ``inside``, A to Z in lower case."""
    low = lower_ascii(raw)
    starts, ends = runs(inside, offsets)
    encoded = strings_of(low.compress(inside), ends - starts).dictionary_encode()
    text = np.searchsorted(offsets, starts, "right") - 1
    return Words(
        text, encoded.indices.to_numpy(), starts, encoded.dictionary, low, offsets
    )


def text_spans(column: pa.Array, size: int = SPAN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi``, their bytes and where each begins in them."""
    raw, offsets = bytes_and_offsets(column)
    for lo, hi in spans_of_rows(offsets, size):
        part = raw[offsets[lo] : offsets[hi]]
        yield lo, hi, part, offsets[lo : hi + 1] - offsets[lo]


def summed(
    tables: Iterable[pa.Table], keys: list[str], value: str, most: int = 400_000
) -> Iterator[pa.Table]:
    """The tables' rows with ``value`` summed by ``keys``, in a few tables of about
    ``most`` rows: what one task sends on. A key may be in several of them."""
    held: list[pa.Table] = []
    rows = 0

    def merged() -> pa.Table:
        table = pa.concat_tables(held)
        if len(held) > 1:
            table = table.group_by(keys, use_threads=False).aggregate([(value, "sum")])
            table = table.rename_columns([*keys, value])
        return table.select([*keys, value])

    for table in tables:
        held.append(table)
        rows += len(table)
        if rows > 2 * most:
            held = [merged()]
            rows = len(held[0])
            if rows > most:
                yield held[0]
                held, rows = [], 0
    if held:
        yield merged()
