"""Byte-level BPE against the tiktoken library, packing against the tokenizers one."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from curbside.llm import byte_bpe
from curbside.llm.byte_bpe import decode, encode, op6_byte_bpe
from curbside.llm.packing import (
    best_fit_decreasing,
    encoding_of,
    lower_bound,
    op8_packing,
    pack,
    pack_documents,
    tokenised_pieces,
)
from tests.conftest import DATA

ODD = ["", " ", "a", "don't  stop\n\n ", "é" * 2000, " x\u0085 y", "1234 ½ 漢字 🙂🙂", None]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@pytest.fixture(scope="module")
def fast_tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def packed_ids(ids):
    return np.array(ids, "<u4").tobytes()


def test_whole_table(spark, library):
    texts = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    want = {}
    for doc_id, text in texts.collect():
        ids = library.encode_ordinary(text or "")
        want[doc_id] = (
            len(ids),
            hashlib.sha256(packed_ids(ids)).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        )
    rows = op6_byte_bpe(spark, f"{DATA}/sf0.01").collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
    assert len(rows) == len(want)


@pytest.mark.parametrize("chars", [1, 10_000_000])
def test_odd_texts(spark, make_docs, library, monkeypatch, chars):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", chars)
    docs = make_docs(*enumerate(ODD), (None, "again"), (1, "again"), (1, "again"))
    rows = decode(encode(docs)).collect()
    got = sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in rows)
    want = sorted(
        (str(i), packed_ids(library.encode_ordinary(t or "")), (t or "").encode())
        for i, t in [*enumerate(ODD), (None, "again"), (1, "again"), (1, "again")]
    )
    assert got == want
    both = encode(docs, decoded=True).collect()
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in both) == want
    assert encode(docs.limit(0)).count() == 0


def assert_packed(rows, capacity=1024):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def plain_pieces(ids, capacity=1024):
    end = (len(ids) - 1) % capacity + 1
    start, number = 0, 0
    while start < len(ids):
        yield number, start, end - start, zlib.crc32(packed_ids(ids[start:end]))
        start, end, number = end, end + capacity, number + 1


def test_packing_of_the_whole_table(spark, fast_tokenizer):
    texts = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    rows = texts.collect()
    encoded = fast_tokenizer.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    want = {(r.doc_id, *p) for r, e in zip(rows, encoded, strict=True) for p in plain_pieces([*e.ids, 2])}
    got = op8_packing(spark, f"{DATA}/sf0.01").collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    assert len(got) == len(want)
    used = assert_packed(got)
    assert used <= 1.005 * sum(r.length for r in got) / 1024 + 1


def test_packing_of_odd_texts(spark, make_docs, fast_tokenizer):
    texts = [*ODD, "<|endoftext|> x", "word " * 3000]
    docs = make_docs(*enumerate(texts), (None, "a"), (0, ""), (0, ""))
    rows = pack_documents(docs, per_part=3).collect()
    assert_packed(rows)
    for i, text in enumerate(texts):
        ids = [*fast_tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = {(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i}
        assert own == set(plain_pieces(ids))
    assert sum(r.doc_id == 0 for r in rows) == 3 and sum(r.doc_id is None for r in rows) == 1
    assert pack_documents(docs.limit(0)).count() == 0


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_ids_are_those_of_the_tokenizers_library(fast_tokenizer, text):
    own = encoding_of(public_tokenizers.path("byte_bpe_50k.json")).encode_ordinary(text)
    assert own == fast_tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_bound_never_exceeds_the_optimum(lengths):
    lengths = np.array(lengths)

    def optimum(left, bins):
        if not left:
            return len(bins)
        best = len(left) + len(bins)
        for i in range(len(bins) + 1):
            if i == len(bins) or bins[i] + left[0] <= 20:
                tried = [*bins, 0] if i == len(bins) else list(bins)
                tried[i] += left[0]
                if len(tried) < best:
                    best = min(best, optimum(left[1:], tried))
        return best

    bins, offsets = best_fit_decreasing(lengths, 20)
    assert np.bincount(bins, weights=lengths).max() <= 20
    assert lower_bound(lengths, 20) <= optimum(sorted(lengths.tolist(), reverse=True), [])


def test_exchange_saves_bins(spark, make_docs):
    """Parts of three pieces each waste half their room; dealt again they don't."""
    docs = make_docs(*[(i, "word " * 340) for i in range(30)])
    pieces = tokenised_pieces(docs)
    alone = assert_packed(pack(pieces, per_part=3, most_rounds=0).collect())
    exchanged = assert_packed(pack(pieces, per_part=3).collect())
    assert exchanged <= alone
