"""Language, toxicity and quality: held-out accuracy, and what they do at the edges."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbside.llm import toxicity
from curbside.llm.language import (
    codewords,
    language_of,
    learn_languages,
    op7_language,
    predict,
    train,
)
from curbside.llm.ngrams import Grams, repeated_words, shares, table_sums
from curbside.llm.quality import (
    FAMILIES,
    NEIGHBOURS,
    _nearest,
    _unit,
    fit,
    learn_quality,
    op10_quality,
    quality_of,
    vote,
)
from curbside.llm.toxicity import (
    Network,
    learn_toxicity,
    op5_toxicity,
    toxicity_of,
    window_starts,
    words_of,
    worst_windows,
)
from tests.conftest import DATA
from tests.llm.conftest import LABELS


def offsets_of(texts):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return raw, np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.fixture(scope="module")
def known(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").join(
        spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id", "left"
    )
    return {r.doc_id: r for r in rows.select("doc_id", "lang", "quality", "toxic").collect()}


def test_language_held_out(spark, known):
    rows = op7_language(spark, f"{DATA}/sf0.1").collect()
    assert len(rows) == len(known)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == known[r.doc_id].lang for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_held_out(spark, known):
    rows = op5_toxicity(spark, f"{DATA}/sf0.1").collect()
    assert len(rows) == len(known)
    held = [r for r in rows if r.held_out and known[r.doc_id].toxic is not None]
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) for r in rows)
    # In these tables some rows are called toxic that hold no toxic word any more.
    assert np.mean([r.predicted == known[r.doc_id].toxic for r in held]) > 0.95
    toxic = [r.score for r in held if known[r.doc_id].toxic]
    clean = [r.score for r in held if not known[r.doc_id].toxic]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_quality_held_out(spark, known):
    rows = op10_quality(spark, f"{DATA}/sf0.1").collect()
    assert len(rows) == len(known)
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out and known[r.doc_id].quality is not None]
    assert np.mean([r.predicted == known[r.doc_id].quality for r in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 40):
        code = codewords(n)
        apart = (code[:, None] != code[None]).sum(axis=2)
        assert apart[~np.eye(n, dtype=bool)].min() >= max(1, code.shape[1] // 5)


def test_slices_do_not_change_sums(monkeypatch):
    draw = np.random.default_rng(0)
    texts = [bytes(draw.integers(97, 101, n).astype(np.uint8)) for n in (0, 1, 2, 3, 700, 0, 5, 64)]
    raw, offsets = offsets_of(texts)
    families = (Grams(2, 6), Grams(3, 6, "lower"))
    tables = [draw.standard_normal((64, 3)) for _ in families]
    whole = table_sums(raw, offsets, families, tables)
    by_share = sum(s @ t for s, t in zip(shares(raw, offsets, families), tables, strict=True))
    monkeypatch.setattr("curbside.llm.ngrams.SLICE", 7)
    assert np.allclose(whole, table_sums(raw, offsets, families, tables))
    assert np.allclose(whole, by_share, atol=1e-5)
    alone = [table_sums(*offsets_of([t]), families, tables)[0] for t in texts]
    assert np.allclose(whole, alone)


@pytest.mark.parametrize("size", [1, 2, 3, 1 << 18])
def test_repeated_words_stay_within_a_text(monkeypatch, size):
    monkeypatch.setattr("curbside.llm.ngrams.SLICE", size)
    raw, offsets = offsets_of([b"of of on", b"on  on", b"", b"x"])
    assert bytes(repeated_words(raw, offsets)) == bytes(
        [0, 0, 0, 1, 1, 0, 0, 0] + [0, 0, 0, 0, 1, 1] + [0]
    )


def test_windows_hold_every_word():
    for n in (1, 63, 64, 65, 112, 113, 500):
        starts = window_starts(n)
        held = {w for s in starts for w in range(s, min(s + toxicity.WINDOW, n))}
        assert held == set(range(n))


def test_words_do_not_depend_on_what_is_around():
    one = words_of(np.frombuffer(b"Idiot", np.uint8))
    two = words_of(np.frombuffer(b"a, idiot! b", np.uint8))
    begin, count = two.begins[1], two.counts[1]
    assert two.bucket[1] == one.bucket[0] and two.whole[1] == one.whole[0]
    assert two.grams[begin : begin + count].tolist() == one.grams.tolist()


def test_gradients_of_the_network(monkeypatch):
    net = Network.fresh()
    for name in net.p:
        net.p[name] = net.p[name].astype(np.float64)
    draw = np.random.default_rng(1)
    x = draw.standard_normal((3, 5, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    held = np.arange(5) < np.array([[5], [3], [1]])
    target, worth = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        logit = net.run(x.astype(np.float64), held)
        return (np.logaddexp(0, logit) - target * logit).sum() / 3

    g, d_x = net.gradients(x, held, target, worth)
    for name, index in (("wx", (0, 2, 5)), ("wh", (1, 3, 25)), ("bh", (0, 12)), ("att", (4,)),
                        ("out", (17,)), ("bias", (0,))):
        kept = net.p[name][index]
        step = 1e-2
        net.p[name][index] = kept + step
        up = loss()
        net.p[name][index] = kept - step
        down = loss()
        net.p[name][index] = kept
        assert g[name][index] == pytest.approx((up - down) / (2 * step), abs=2e-4)
    kept = x[1, 2, 4]
    x[1, 2, 4] = kept + 1e-2
    up = loss()
    x[1, 2, 4] = kept - 1e-2
    down = loss()
    assert d_x[1, 2, 4] == pytest.approx((up - down) / 2e-2, abs=2e-4)


def test_long_texts_are_scored_whole(monkeypatch):
    """A word at the end of a text of many slices counts as much as in a short one."""
    net = Network.fresh()
    filler = b"word and other things " * 400
    texts = [filler + b"poison " + filler, filler + filler, b"poison", b"", b"!!"]
    whole = worst_windows(net, *offsets_of(texts))
    monkeypatch.setattr(toxicity, "_SLICE", 4000)
    sliced = worst_windows(net, *offsets_of(texts))
    # Windows lie elsewhere, so scores may differ a little, but not what is found.
    assert np.isneginf(sliced[3]) and np.isneginf(sliced[4]) and np.isneginf(whole[3])
    assert np.allclose(whole[:3], sliced[:3], atol=0.2)
    assert np.allclose(whole[2], worst_windows(net, *offsets_of([b"poison"]))[0])


def test_edges(spark, make_docs):
    docs = make_docs((1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "the end", "en"),
                     (5, "le bout", "fr"), (5, "le bout", "fr"), (None, "oui", "fr"))
    model = learn_languages(docs, F.lit(True))
    rows = docs.select("doc_id", language_of(docs.text, model).alias("f")).collect()
    by_id = {r.doc_id: r.f for r in rows}
    assert len(rows) == 7
    assert [by_id[i].lang for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "fr"]
    assert by_id[1].score == 0
    nothing = learn_languages(docs.filter("lang IS NULL"), F.lit(True))
    assert {r[0].lang for r in docs.select(language_of(docs.text, nothing)).collect()} == {"und"}

    labels = spark.createDataFrame(
        [(4, 1, 0), (5, 0, 1), (5, 0, 1), (9, 1, 1), (None, 1, 1), (2, None, None)], LABELS
    )
    net = learn_toxicity(docs, labels, F.lit(True))
    scores = {r[0]: r[1] for r in docs.select("doc_id", toxicity_of(docs.text, net)).collect()}
    assert scores[1] == scores[2] == 0 and all(0 <= s <= 1 for s in scores.values())
    space = learn_quality(docs, labels, F.lit(True))
    scores = [r[0] for r in docs.select(quality_of(docs.text, space)).collect()]
    assert len(scores) == 7 and all(0 <= s <= 1 for s in scores)
    none = labels.limit(0)
    assert docs.select(toxicity_of(docs.text, learn_toxicity(docs, none, F.lit(True)))).count() == 7
    empty = learn_quality(docs, none, F.lit(True))
    assert {r[0] for r in docs.select(quality_of(docs.text, empty)).collect()} == {0.5}
    assert docs.limit(0).select(quality_of(docs.text, space)).count() == 0


def test_nearest_take_ties_in_order():
    draw = np.random.default_rng(3)
    near = draw.integers(0, 6, (50, 40)).astype(np.float32)
    near[0], near[1, :] = 1, np.arange(40)
    found = _nearest(near, 15)
    for row, places in zip(near, found, strict=True):
        expected = sorted(range(40), key=lambda i: (-row[i], i))[:15]
        assert sorted(places.tolist()) == sorted(expected)


def test_votes_of_copies_on_both_sides_of_the_last_place():
    texts = [b"one text and its copies"] * 40 + [b"$$$ ### %d" % i for i in range(9)]
    labels = [1] * 10 + [0] * 30 + [0] * 9
    space = fit(texts, labels)
    votes = space.votes[:15]
    expected = votes[:10].sum() / votes.sum()
    assert vote(space, *offsets_of([texts[0]] * 3)) == pytest.approx([expected] * 3)


def plain_votes(space, vector):
    """All cosines one by one, the largest first, ties by place."""
    cosines = [sum(a * b for a, b in zip(vector, v, strict=True)) for v in space.vectors.tolist()]
    best = sorted(range(len(cosines)), key=lambda i: (-cosines[i], i))[:NEIGHBOURS]
    weight = [max(cosines[i], 0) ** 2 * space.votes[i] for i in best]
    return sum(w * space.labels[i] for w, i in zip(weight, best, strict=True)) / sum(weight)


def test_votes_equal_all_cosines_one_by_one():
    draw = np.random.default_rng(5)
    words = [b"the", b"a", b"of", b"buy", b"now", b"$$$", b"###", b"day", b"night"]
    texts = [b" ".join(draw.choice(words, 12).tolist()) for _ in range(160)]
    space = fit(texts[:120], draw.integers(0, 2, 120).tolist())
    raw, offsets = offsets_of(texts[120:])
    vectors = _unit(table_sums(raw, offsets, FAMILIES, space.tables) - space.centre)
    expected = [plain_votes(space, v) for v in vectors.tolist()]
    assert vote(space, raw, offsets) == pytest.approx(expected, abs=1e-4)


def test_bits_weigh_what_unseen_rows_show():
    """Languages a and b are noise to each other: the bits that split them are learned
    by heart, and weigh less than those that split c from both."""
    draw = np.random.default_rng(1)

    def noise(letters):
        return bytes(draw.choice(list(letters), 60).tolist())

    names = ["a", "b", "c"] * 60
    texts = [noise(b"xyz" if n == "c" else b"pqrstuv") for n in names]
    model = train(texts, names)
    apart = model.codes[0] != model.codes[1]
    assert apart.any() and not apart.all()
    assert model.weights[apart].max() < 0.5 * model.weights[~apart].min()


def test_votes_are_those_of_all_cosines():
    texts = [b"the a of %d" % i for i in range(40)] + [b"$$$ ### %d" % i for i in range(40)]
    space = fit(texts, [1] * 40 + [0] * 40)
    score = vote(space, *offsets_of([b"the of a of", b"### $$$ ###"]))
    assert score[0] > 0.9 and score[1] < 0.1


def test_one_language_only():
    model = train([b"abc", b"abd"], ["xx", "xx"])
    best, score, _ = predict(model, *offsets_of([b"abc"]))
    assert model.languages[best[0]] == "xx" and score[0] == 1
