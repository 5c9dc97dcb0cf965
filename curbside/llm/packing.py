"""Best-fit packing of tokenised documents, repacked until bounds certify it.

Each partition of pieces is packed by best-fit decreasing. Dual feasible functions
give a lower bound of its bin count; a partition that meets it is settled for good.
Partitions with a gap give up their loosest bins, the others the one that is least
full; those pieces are dealt among each other and packed again, as long as that
saves bins.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import read_table, written

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024

# Pieces that one task packs.
PARTITION_PIECES = 2_000
MOST_ROUNDS = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself where that is a visible
    Latin-1 character, and the others as the characters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoding_of(path: str) -> tiktoken.Encoding:
    """An encoder with the ids of a byte-level BPE file of the tokenizers library.

    Ids are also the ranks of the merges there, which ``tests/llm`` checks against
    that library; this encoder takes a seventh of its time. Strings of special
    tokens within a text are ordinary text.
    """
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    special = {t["content"] for t in described.get("added_tokens", [])}
    byte_of = _byte_of_character()
    ranks = {
        bytes(byte_of[c] for c in token): rank
        for token, rank in described["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding(
        "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def tokenised_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
) -> DataFrame:
    """The pieces of every document, from one pass over whole texts.

    A document is its token ids and then ``end_id``; one longer than ``capacity``
    is cut so that all its pieces but the first are full. A null or empty text is
    the one token ``end_id``. Every row is a document of its own, whatever its id.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(path)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                ids = encoding.encode_ordinary(text.as_py() or "")
                ids.append(end_id)
                raw = np.array(ids, "<u4")
                place = 0
                end = (len(ids) - 1) % capacity + 1
                while place < len(ids):
                    columns[0].append(doc_id)
                    columns[1].append(0 if place == 0 else columns[1][-1] + 1)
                    columns[2].append(place)
                    columns[3].append(end - place)
                    columns[4].append(zlib.crc32(raw[place:end].tobytes()))
                    place, end = end, end + capacity
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int32()),
                    *[pa.array(c, pa.int64()) for c in columns[2:]],
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return chosen.mapInArrow(of_partition, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first into the fullest bin that
    takes it. Bins are found by their room, of which there are ``capacity`` kinds."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, opened
            opened += 1
        bins[i], offsets[i] = chosen, capacity - room
        left = room - length
        if left:
            with_room[left].append(chosen)
            rooms |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most bins that any dual feasible function of two families calls for.

    One rounds lengths over half up and drops those below a threshold; the other
    counts how many times a length fills a k-th of a bin. Both map lengths that
    share a bin to no more than one bin in all, so their sum is a bound.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    for threshold in range(1, capacity // 2 + 1):
        value = np.where(
            sizes > capacity - threshold, capacity, np.where(sizes < threshold, 0, sizes)
        )
        best = max(best, -(-int((counts * value).sum()) // capacity))
    for k in range(1, 101):
        whole = (k + 1) * sizes
        value = np.where(whole % capacity == 0, sizes * k, whole // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


PACKED = f"{PIECES}, part long, round int, bin long, offset long, loose boolean"


def _pack(round_no: int, capacity: int):
    """Packs one partition and marks the bins it gives up: of one that meets its
    bound the least full."""

    def of_group(rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
        rows = rows.sort_by([*order, ("ids_crc32", "ascending")])
        lengths = rows["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        used = int(bins.max()) + 1
        gap = used - lower_bound(lengths, capacity)
        filled = np.bincount(bins, weights=lengths, minlength=used)
        # With a gap a tenth of the bins, and enough for the room of the gap;
        # else the one whose fraction the bound has rounded up.
        given = np.argsort(filled, kind="stable")[: max(used // 10, 8 * gap) if gap else 1]
        loose = np.zeros(used, bool)
        loose[given] = filled[given] < capacity
        added = {
            "round": np.full(len(lengths), round_no, np.int32),
            "bin": bins,
            "offset": offsets,
            "loose": loose[bins],
        }
        for name, values in added.items():
            rows = rows.append_column(name, pa.array(values))
        return rows

    return of_group


def _packed(pieces: DataFrame, round_no: int, capacity: int) -> DataFrame:
    packed = pieces.groupBy("part").applyInArrow(_pack(round_no, capacity), PACKED)
    return written(packed, f"packing-{round_no}")


def _dealt(pieces: DataFrame, total: int, seed: int, per_part: int) -> DataFrame:
    """Pieces dealt at random, but repeatably, into parts of about ``per_part``."""
    parts = max(1, -(-total // per_part))
    draw = F.xxhash64(
        F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "piece", "length", "ids_crc32"
    )
    return pieces.withColumn("part", F.pmod(draw, F.lit(parts)))


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    per_part: int = PARTITION_PIECES,
    most_rounds: int = MOST_ROUNDS,
) -> DataFrame:
    """``sequence_id`` and ``offset`` for each of the written ``pieces``.

    A full piece is a sequence of its own. The others are packed by partition.
    After each round the bins marked loose are pooled if they come from more than
    one partition: pooled pieces are dealt anew and packed together. A round that
    doesn't save a bin is not used and ends the exchange. Bins keep the number of
    the round, partition and place they were packed in.
    """
    full = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity)
    total = rest.count()
    settled = []
    if total:
        current = _packed(_dealt(rest, total, 0, per_part), 0, capacity)
        for round_no in range(1, most_rounds + 1):
            loose = current.filter("loose")
            held = loose.agg(
                F.count_distinct("part"), F.count_distinct("part", "bin"), F.count(F.lit(1))
            ).first()
            if held[0] < 2:
                break
            again = _packed(
                _dealt(loose.select(*pieces.columns), held[2], round_no, per_part),
                round_no,
                capacity,
            )
            if again.select(F.count_distinct("part", "bin")).first()[0] >= held[1]:
                break
            settled.append(current.filter("not loose"))
            current = again
        settled.append(current)
    number = F.shiftleft("round", 56).bitwiseOR(F.shiftleft("part", 32)).bitwiseOR(F.col("bin"))
    packed = full.withColumns(
        {
            "sequence_id": -1 - F.abs(F.monotonically_increasing_id()),
            "offset": F.lit(0).cast("long"),
        }
    )
    for part in settled:
        packed = packed.unionByName(
            part.withColumn("round", F.col("round").cast("long"))
            .withColumn("sequence_id", number)
            .select(*pieces.columns, "sequence_id", "offset")
        )
    return packed


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    per_part: int = PARTITION_PIECES,
) -> DataFrame:
    """Pieces of all documents with the sequence and the place they are packed in.

    Null and empty texts are pieces of one token; equal rows are packed each; ties
    in length are broken by id, so results repeat. Columns other than the two
    named are not looked at. An empty table gives an empty one.
    """
    pieces = written(tokenised_pieces(docs, id_col, text_col, capacity=capacity), "pieces")
    return pack(pieces, capacity, per_part)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
