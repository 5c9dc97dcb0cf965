"""SimHash against a version that compares all fingerprints."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from curbside.llm.components import components
from curbside.llm.simhash import fingerprint, links, near_duplicates, op3_simhash
from tests.conftest import DATA


def plain_fingerprint(text: str | None) -> int:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict[int, int], bits: int = 3) -> dict[int, int]:
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    root = {}
    for i in ids:
        if i in root:
            continue
        todo = [i]
        while todo:
            one = todo.pop()
            if one not in root:
                root[one] = i
                near = np.bitwise_count(values ^ np.uint64(prints[one])) <= bits
                todo += [ids[j] for j in np.flatnonzero(near)]
    return root


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    roots = plain_components(prints)
    found = op3_simhash(spark, f"{DATA}/sf0.01").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {
        i: (f"{prints[i]:016x}", roots[i]) for i in prints
    }
    assert len(found) == len(prints)
    assert any(r.doc_id != r.component_id for r in found)


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a B", "x y z", "É é É ß", "w " * 70_000])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("block", [4, 1024])
def test_links_of_random_flips(spark, block):
    draw = np.random.default_rng(0)
    seeds = draw.integers(0, 2**63, 12).tolist()
    values = set(seeds)
    for seed in seeds:
        for _ in range(25):
            one = seed
            for bit in draw.choice(64, draw.integers(0, 6), replace=False).tolist():
                one ^= 1 << bit
            values.add(one)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.node: r.root for r in components(links(prints, block=block)).collect()}
    groups = plain_components({v: int(np.int64(v).view(np.uint64)) for v in signed})
    assert {v: found.get(v, v) for v in signed} == groups


def test_nulls_repeats_and_empty(spark, make_docs):
    docs = make_docs((3, None), (1, ""), (1, ""), (None, " "), (9, "a b c d"), (7, "a b c d"),
                     (None, "lonely text of its own"))
    found = sorted(
        ((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str
    )
    assert found == sorted(
        [(3, 1), (1, 1), (1, 1), (None, 1), (9, 7), (7, 7), (None, None)], key=str
    )
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame(
        [(i, i + 1) for i in range(200)] + [(5, 5), (None, 3), (7, 6)], "a long, b long"
    )
    assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(1, 201)}
