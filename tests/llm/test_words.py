"""Collocations, spelling variants and language-model scores against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curbside.llm import collocations as C
from curbside.llm import context_mixing as M
from curbside.llm.bloom import bloom_of
from curbside.llm.collocations import collocations
from curbside.llm.context_mixing import scored_by_the_rest
from curbside.llm.spelling import spelling_variants
from curbside.llm.toxicity import Network, toxicity_of, train, worst_windows
from tests.conftest import rows_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_by_brute_force(docs, least, most):
    count, total = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    count[lang, tuple(words[i : i + m])] += 1
    known = {k: a for k, a in count.items() if a >= least}
    out = []
    for (lang, p), a in known.items():
        if len(p) == 1:
            continue
        score, k = min(
            (2_000_000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))
        )
        inside = any(
            of == lang and len(q) > len(p) and 100 * b >= 80 * a
            and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (of, q), b in known.items()
        )
        if not inside:
            out.append((lang, " ".join(p), a, count[lang, p[:k]], count[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in {row[0] for row in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i, *row[1:]) for i, row in enumerate(own[:most], 1)]
    return sorted(ranked)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("hot", [1 << 16, 20])
def test_collocations_equal_brute_force(spark, make_docs, monkeypatch, hot):
    # With a low bound the stripes of common prefixes are cut into segments.
    monkeypatch.setattr(C, "HOT", hot)
    draw = random.Random(4)
    words = ["the", "The", "of", "naïve", "x y", "new", "york", "city", "a"]
    docs = [
        (i, " ".join(draw.choices(words, k=draw.randrange(40))) + draw.choice([".", " ,new york city\n", ""]),
         draw.choice(["en", "de", None, "und"]))
        for i in range(60)
    ]
    docs += [(None, None, "en"), (1, "", None), (2, " \t,.;", "en"), (3, "a " * 3000, "fr")]
    docs += [(4, "new york city hall", "en")] * 12
    found = collocations(make_docs(*docs).repartition(5), least=8, most=25)
    assert sorted(rows_of(found, *COLUMNS)) == phrases_by_brute_force(docs, 8, 25)


def test_no_documents_have_no_collocations(make_docs):
    docs = make_docs((1, "a b", "en"))
    assert rows_of(collocations(docs.limit(0))) == []
    assert rows_of(collocations(docs)) == []


def test_bloom_filters_keep_every_item(spark):
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h"))
    items = np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64)
    found = bloom_of(hashes, "h")
    assert found.has(items).all()
    assert found.has(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.05


def variants_by_brute_force(docs):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    n = {w: c for w, c in count.items() if c >= 2}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))

    around = {w: [v for v in n if v != w and near(v, w)] for w in n}
    first = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in first.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(
        (w, form.get(w), root(w), n[w], len(around[w]), n[form[w]] if w in form else None) for w in n
    )


def test_spelling_equals_brute_force(make_docs):
    draw = random.Random(7)
    letters = "abÀÿ"
    base = ["".join(draw.choices(letters, k=draw.randrange(7, 10))) for _ in range(60)]
    docs = []
    for i in range(200):
        words = []
        for _ in range(30):
            w = draw.choice(base)
            k = draw.randrange(len(w))
            words.append(draw.choice([w, w[:k] + w[k + 1 :], w[:k] + draw.choice(letters) + w[k:], w.upper()]))
        docs.append((i, draw.choice([" ", "-", "3"]).join(words)))
    # A chain of forms, long words, repeated rows, nulls and empty texts.
    docs += [(1000 + i, "abcdefgh " * 5000 + "abcdefgx " * 300 + "abcdefyx " * 20) for i in range(2)]
    docs += [(2000, "q" * 900 + " " + "q" * 901 + " x")] * 2
    docs += [(None, "abcdefgh qqqqqqqq"), (None, None), (5, ""), (6, "1234 ÷×")]
    found = spelling_variants(make_docs(*docs).repartition(4))
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(rows_of(found, *columns)) == variants_by_brute_force(docs)


def test_no_documents_have_no_words(make_docs):
    assert rows_of(spelling_variants(make_docs((1, "abcdefgh")).limit(0))) == []


def mixed_docs():
    draw = random.Random(3)
    common = {"en": ["the", "of", "and", "to"], "de": ["der", "und", "die", "das"]}
    docs = []
    for i in range(300):
        lang = "en" if i % 2 else "de"
        docs.append((i, " ".join(draw.choices(common[lang], k=80)) + f" rare{i}"))
    docs += [(None, None), (301, ""), (302, " \n"), (303, "The\tTHE"), (303, "The\tTHE")]
    docs += [(304, "word " * 70_000)]
    return docs


def test_base_scores_and_counts_are_exact(make_docs, monkeypatch):
    monkeypatch.setattr(M, "HEAD", 6)  # so that most tokens are joined
    docs = mixed_docs()
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    found = scored_by_the_rest(make_docs(*docs).repartition(3), held)
    rows = found.collect()
    assert len(rows) == len(docs)

    def tokens(text):
        return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), ""]

    def out(i):
        return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1

    count = Counter(t for i, text in docs if not out(i) for t in tokens(text))
    total, distinct = sum(count.values()), len(count)
    expected = []
    for i, text in docs:
        own = tokens(text)
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in own)
        expected.append((str(i), out(i), len(own), sum(count[t] > 0 for t in own), total, round(base, 6)))
    got = [
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
        for r in rows
    ]
    assert sorted(got) == sorted(expected)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    # Words of one language follow each other, which the counts alone don't see.
    long = [r for r in rows if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in long) > 0.9 * sum(r.base_score for r in long)


def test_no_documents_have_no_scores(make_docs):
    assert rows_of(scored_by_the_rest(make_docs((1, "a")).limit(0), F.lit(False))) == []
    assert len(rows_of(scored_by_the_rest(make_docs((1, "a"), (2, None)), F.lit(True)))) == 2


def test_code_probabilities_add_up_to_one():
    """Of all codes in one place of a text, by a model that has seen something."""
    codes = np.arange(1 << M.CODE_BITS, dtype=np.int32)
    draw = np.random.default_rng(5)
    nodes = draw.integers(0, 50, (2, 1 << M.CODE_BITS)).astype(np.float32)
    tables = (draw.integers(0, 9, (M.ORDERS, 1 << 14)) + 1j).astype(np.complex64)
    counts = M.Counts(nodes, tables, np.zeros(1), np.zeros(1))
    past = np.zeros(len(codes), np.uint64)
    # Texts of one token each have the same empty past.
    block = M.Block(codes, past, np.arange(len(codes) + 1))
    assert abs((10.0 ** M.bit_scores(block, counts, M.fresh_mixer()).astype(float)).sum() - 1) < 1e-3


def test_counts_so_far_are_those_of_the_document():
    draw = np.random.default_rng(2)
    bounds = np.array([0, 0, 5, 40, 41, 90])
    codes = draw.integers(0, 4, 90).astype(np.int32) << (M.CODE_BITS - 2)
    for level, (zeros, ones) in enumerate(M.counts_so_far(codes, bounds)):
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            for t in range(lo, hi):
                before = codes[lo:t]
                left = M.CODE_BITS - level
                same = before[before >> left == codes[t] >> left] >> (left - 1) & 1
                assert (zeros[t], ones[t]) == ((same == 0).sum(), (same == 1).sum())


def test_a_toxic_passage_counts_wherever_it_stands():
    draw = random.Random(1)
    clean = [f"word{i}" for i in range(300)]

    def text(toxic, k):
        body = draw.choices(clean, k=k)
        if toxic:
            body += ["vile", "filth", "scum"] * 8
        return " ".join(body).encode()

    labels = [i % 2 for i in range(120)]
    texts = [text(y, 6000 if i < 6 else 60) for i, y in enumerate(labels)]
    net = train(texts, labels)
    pair = [text(False, 6000), text(True, 6000)]
    offsets = np.array([0, len(pair[0]), len(pair[0]) + len(pair[1])])
    clean_score, toxic_score = worst_windows(net, np.frombuffer(b"".join(pair), np.uint8), offsets)
    assert toxic_score > clean_score


def test_training_that_comes_to_nothing_fails(monkeypatch):
    from curbside.llm import toxicity as T

    draw = random.Random(1)
    texts = [" ".join(draw.choices("abcdefgh", k=30)).encode() for _ in range(200)]
    labels = [i % 2 for i in range(200)]
    monkeypatch.setattr(T, "_trained", lambda *a: (Network.fresh(), -1.0, True))
    with pytest.raises(RuntimeError, match="nothing can be rejected"):
        train(texts, labels)


def test_a_poisoned_network_rejects_no_text_in_silence(make_docs):
    net = Network.fresh()
    net.p["att"][0] = np.nan
    with pytest.raises(Exception, match="not a number"):
        make_docs((1, "some words")).select(toxicity_of(F.col("text"), net)).collect()


def test_contexts_keep_counts_of_their_own(spark, make_docs):
    """Each of 20,000 words has one successor: the mixed bits must give most of it away,
    so neither the rest of the code nor shared slots may hide it."""
    draw = np.random.default_rng(5)
    after = draw.permutation(20_000)
    docs = []
    for doc in range(1, 1501):
        word, text = int(draw.integers(20_000)), []
        for _ in range(100):
            text.append(f"w{word}")
            word = int(after[word])
        docs.append((doc, " ".join(text)))
    held = F.col("doc_id") % 5 == 1
    found = scored_by_the_rest(make_docs(*docs).repartition(2), held).filter("held_out")
    won = found.select((F.sum(F.col("score") - F.col("base_score")) / F.sum("n_tokens")).alias("won"))
    assert won.first().won > 1.0
    assert [M.slot_bits(n) for n in (0, 1 << 14, 10**6, 10**10)] == [14, 15, 20, 22]


def test_a_context_finds_three_levels_side_by_side():
    """Two texts of one token each: 14 nodes in either order's table, in 5 runs of 8 slots."""
    nodes = np.ones((2, 1 << M.CODE_BITS), np.float32)
    codes = np.array([5, 1 << (M.CODE_BITS - 1)], np.int32)
    for which in ([0], [0, 1]):
        counts = M.Counts(nodes, np.zeros((M.ORDERS, 1 << 20), np.complex64), np.zeros(1), np.zeros(1))
        own = codes[which]
        block = M.Block(own, np.zeros(len(own), np.uint64), np.arange(len(own) + 1))
        M.Learner(counts).learn(block)
        for table in counts.tables:
            assert table.real.sum() + table.imag.sum() == M.CODE_BITS * len(own)
            runs = np.unique(np.flatnonzero(table) // 8)
            # The second token parts from the first after the root.
            assert len(runs) == (5 if len(own) == 1 else 9)


def test_slots_are_all_used_alike():
    """Laying levels side by side leaves none of the slots empty, so contexts share no more."""
    draw = np.random.default_rng(8)
    n = 1 << 14
    codes = draw.integers(0, 1 << M.CODE_BITS, n).astype(np.int32)
    hashes = draw.integers(0, 1 << 63, n).astype(np.uint64)
    nodes = np.full((2, 1 << M.CODE_BITS), 9, np.float32)
    counts = M.Counts(nodes, np.zeros((M.ORDERS, 1 << 17), np.complex64), np.zeros(1), np.zeros(1))
    M.Learner(counts).learn(M.Block(codes, hashes, np.array([0, n])))
    for table in counts.tables:
        empty = (table == 0).reshape(-1, 8).mean(axis=0)
        assert np.ptp(empty) < 0.02
        # As many as if each of the 14 n counts had fallen anywhere.
        assert abs(empty.mean() - math.exp(-M.CODE_BITS * n / table.size)) < 0.02


def test_counting_tokens_hashes_none(monkeypatch):
    def refused(values):
        raise AssertionError("tokens are counted by their bytes")

    monkeypatch.setattr(M, "hashes_of", refused)
    raw = np.frombuffer(b"a b a", np.uint8)
    counted = M.Tokens(raw, np.array([0, 3, 5])).counts().to_pylist()
    assert {r["token"]: r["n"] for r in counted} == {"a": 2, "b": 1, "": 2}


def test_log_probabilities_are_those_of_each_decision():
    """The product of a code's decisions is told apart down to the least of each."""
    nodes = np.zeros((2, 1 << M.CODE_BITS), np.float32)
    nodes[0] = 1e9
    counts = M.Counts(nodes, np.zeros((M.ORDERS, 1 << 14), np.complex64), np.zeros(1), np.zeros(1))
    mixer = M.fresh_mixer()
    mixer.refined[0] = 0
    last = (1 << M.CODE_BITS) - 1
    block = M.Block(np.array([0, last], np.int32), np.zeros(2, np.uint64), np.arange(3))
    likely, unlikely = M.bit_scores(block, counts, mixer)
    assert -1e-3 < likely < 0
    assert abs(unlikely - M.CODE_BITS * math.log10(M.LEAST_P)) < 1e-3


def test_words_of_several_spans_are_looked_up_at_once(monkeypatch):
    draw = np.random.default_rng(3)
    head = pa.array(["w1", "", "w4"])
    asked = []
    index_in = M.pc.index_in
    monkeypatch.setattr(M.pc, "index_in", lambda *a, **k: asked.append(1) or index_in(*a, **k))
    spans = []
    for i in range(7):
        raw = " ".join(f"w{k}" for k in draw.integers(0, 6, 30)).encode()
        spans.append((i, M.Tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))))
    for most, times in ((1, 7), (62, 4), (10**6, 1)):
        asked.clear()
        monkeypatch.setattr(M, "_LOOKED_UP", most)
        found = list(M.in_head(spans, head))
        assert [i for i, _, _ in found] == list(range(7)) and len(asked) == times
        for _, tokens, place in found:
            known = head.to_pylist()
            assert place.tolist() == [known.index(t) if t in known else -1 for t in tokens.distinct.to_pylist()]
    assert list(M.in_head([], head)) == []
