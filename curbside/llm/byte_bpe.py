"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. Each block of texts keeps its own list of distinct
words and, by position, their places in it. The lists are dealt by a hash of the
word, so that every distinct word of the corpus is encoded once; the ids go back to
the blocks, which reassemble their texts by position. Decoding looks token bytes up
in the vocabulary's table.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import bytes_and_offsets, read_table

RANKS = "byte_bpe_multi_50k.tiktoken"

# Text of one block, in characters; a longer text is a block of its own.
BLOCK_CHARS = 6_000_000

BLOCK = "block long, doc_ids array<long>, counts array<int>, codes binary, words binary"
DEALT = "part int, block long, words binary"
ENCODED = "block long, part int, counts binary, ids binary"


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=2)
def encoding_of(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding(
        "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path),
        special_tokens={},
    )


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after another, and where each id's begin."""
    by_id = {rank: token for token, rank in _ranks(path).items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    begins = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
    return np.frombuffer(b"".join(tokens), np.uint8), begins


def gathered(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``begins``, one after another."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(begins - before, lengths) + np.arange(int(lengths.sum()))]


def _squeezed(numbers: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers by bytes of equal weight, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def _numbers(squeezed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(squeezed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _squeezed_words(words: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in words], "<u4")
    head = np.array([len(words)], "<u4").tobytes() + lengths.tobytes()
    return zstandard.compress(head + b"".join(words), 3)


def _words(squeezed: bytes) -> list[bytes]:
    raw = zstandard.decompress(squeezed)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate(([4 + 4 * n], ends))[:n]
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _parts_of(words: list[bytes], parts: int) -> np.ndarray:
    return np.array([zlib.crc32(w) % parts for w in words], np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts cut into pre-tokens. A block is named by a hash of what it
    holds, so ids can never be given to other words than those asked for."""
    pattern = regex.compile(public_tokenizers.PATTERN)

    def done() -> pa.RecordBatch:
        words = _squeezed_words([w.encode() for w in index])
        codes = _squeezed(np.concatenate(coded) if coded else np.zeros(0, np.int64))
        name = xxhash.xxh3_64_intdigest(codes + words + repr((doc_ids[:1], counts)).encode())
        arrays = [
            pa.array([name - (1 << 63)], pa.int64()),
            pa.array([doc_ids], pa.list_(pa.int64())),
            pa.array([counts], pa.list_(pa.int32())),
            pa.array([codes], pa.binary()),
            pa.array([words], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["block", "doc_ids", "counts", "codes", "words"])

    index: dict[str, int] = defaultdict(count().__next__)
    doc_ids, counts, coded, size = [], [], [], 0
    for batch in batches:
        for doc_id, value in zip(batch[0].to_pylist(), batch[1], strict=True):
            text = value.as_py() or ""
            if doc_ids and size + len(text) > BLOCK_CHARS:
                yield done()
                index = defaultdict(count().__next__)
                doc_ids, counts, coded, size = [], [], [], 0
            found = pattern.findall(text)
            coded.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
            doc_ids.append(doc_id)
            counts.append(len(found))
            size += len(text)
    if doc_ids:
        yield done()


def _dealer(parts: int):
    """The distinct words of each block by the part of the corpus's words they are in."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, squeezed in zip(batch["block"], batch["words"], strict=True):
                words = _words(squeezed.as_py())
                part_of = _parts_of(words, parts)
                order = np.argsort(part_of, kind="stable")
                cuts = np.searchsorted(part_of[order], np.arange(parts + 1))
                held = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
                lists = [
                    _squeezed_words([words[i] for i in order[cuts[p] : cuts[p + 1]].tolist()])
                    for p in held
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held, pa.int32()),
                        pa.array([block.as_py()] * len(held), pa.int64()),
                        pa.array(lists, pa.binary()),
                    ],
                    ["part", "block", "words"],
                )

    return deal


def _encoder(path: str):
    """Encodes each distinct word of its part when it first comes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(path)
        known: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        for batch in batches:
            rows = []
            for part, block, squeezed in zip(*(c.to_pylist() for c in batch), strict=True):
                ids_of, ids = known[part], []
                for word in _words(squeezed):
                    found = ids_of.get(word)
                    if found is None:
                        found = ids_of[word] = encoding.encode_ordinary(word.decode())
                    ids.append(found)
                counts = np.array([len(i) for i in ids], np.int64)
                flat = np.array([i for some in ids for i in some], np.int64)
                rows.append((block, part, _squeezed(counts), _squeezed(flat)))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["block", "part", "counts", "ids"],
            ) if rows else pa.RecordBatch.from_arrays(
                [pa.array([], k) for k in kinds], ["block", "part", "counts", "ids"]
            )

    return encode


def bytes_of(ids: bytes, path: str) -> bytes:
    """What token ids, as little-endian 32-bit integers, stand for."""
    table, begins = token_bytes(path)
    own = np.frombuffer(ids, "<u4").astype(np.int64)
    return gathered(table, begins[own], begins[own + 1] - begins[own]).tobytes()


def _reassembler(parts: int, path: str, decoded: bool):
    def reassemble(block: pa.Table, encoded: pa.Table) -> pa.Table:
        own = {name: block[name][0].as_py() for name in block.column_names}
        words = _words(own["words"])
        part_of = _parts_of(words, parts)
        order = np.argsort(part_of, kind="stable")
        cuts = np.searchsorted(part_of[order], np.arange(parts + 1))
        lengths = np.full(len(words), -1, np.int64)
        begins = np.zeros(len(words), np.int64)
        flat, at = [np.zeros(0, np.int64)], 0
        for part, counts, ids in zip(
            *(encoded[c].to_pylist() for c in ("part", "counts", "ids")), strict=True
        ):
            places, n = order[cuts[part] : cuts[part + 1]], _numbers(counts)
            lengths[places] = n
            begins[places] = at + np.cumsum(n) - n
            flat.append(_numbers(ids))
            at += len(flat[-1])
        if (lengths < 0).any():
            raise RuntimeError("words of a block have no ids: its rows changed between reads")
        ids = np.concatenate(flat).astype("<u4")
        codes = _numbers(own["codes"])
        ends = np.cumsum(own["counts"]).tolist()
        found = []
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            mine = codes[start:end]
            found.append(gathered(ids, begins[mine], lengths[mine]).tobytes())
        columns = {
            "doc_id": pa.array(own["doc_ids"], pa.int64()),
            "ids": pa.array(found, pa.binary()),
        }
        if decoded:
            columns["decoded"] = pa.array([bytes_of(i, path) for i in found], pa.binary())
        return pa.table(columns)

    # Equal stretches of texts make equal blocks of one name, whose words are
    # encoded alike, so it doesn't matter whose ids are taken.
    def all_of_name(blocks: pa.Table, encoded: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(
            reassemble(blocks.slice(i, 1), encoded) for i in range(blocks.num_rows)
        )

    return all_of_name


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str | None = None,
    parts: int | None = None,
    decoded: bool = False,
) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids as little-endian unsigned 32-bit
    integers, of every row, and on demand the bytes they are ``decoded`` to, by the
    task that has them at hand.

    Words are dealt into ``parts``, by default as many as the session has shuffle
    partitions. Null and empty texts have no ids; repeated rows come as often as
    they are; other columns are not looked at. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    path = ranks or public_tokenizers.path(RANKS)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    blocks = chosen.mapInArrow(_blocks, BLOCK).repartition(parts, "block")
    encoded = (
        blocks.mapInArrow(_dealer(parts), DEALT)
        .repartition(parts, "part")
        .mapInArrow(_encoder(path), ENCODED)
    )
    return (
        blocks.groupBy("block")
        .cogroup(encoded.groupBy("block"))
        .applyInArrow(
            _reassembler(parts, path, decoded),
            "doc_id long, ids binary" + ", decoded binary" * decoded,
        )
    )


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``encoded`` with the bytes its ``ids`` stand for, as ``decoded``.

    The table of token bytes is as large as the vocabulary, so every task has it.
    Null ids decode to nothing.
    """
    path = ranks or public_tokenizers.path(RANKS)

    @F.arrow_udf("binary")
    def of_batch(column: pa.Array) -> pa.Array:
        raw, offsets = bytes_and_offsets(column)
        each = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        return pa.array([bytes_of(raw[a:b].tobytes(), path) for a, b in each], pa.binary())

    return encoded.withColumn("decoded", of_batch.asNondeterministic()(F.col("ids")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(read_table(spark, sf_dir, "documents"), decoded=True)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
