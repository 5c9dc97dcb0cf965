"""Toxicity by a bidirectional gated recurrent network, trained in numpy.

A word enters as the embedding of its hash beside the sum of embeddings of its
character n-grams. Overlapping windows of words go through a GRU in both directions;
attention pools each window's states into one logit. A document's score is that of
its worst window. All windows of all texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import bytes_and_offsets, fold_of, read_table
from curbside.llm.ngrams import labelled_sample, labels_of, lower_ascii

FOLDS = 5
WINDOW = 64
STRIDE = 48

# Training: rows of each label. The network is fitted on no more; scoring always reads
# all texts.
ROWS_PER_LABEL = 600
EPOCHS = 10
# Steps that a small sample is gone through again for, up to so many epochs.
LEAST_STEPS, MOST_EPOCHS = 160, 40
# Of the sample, every so many-th document is kept for calibration, and to see whether
# the training has come to anything: the share of pairs of a toxic and a clean one that
# it puts in order. Below GOOD another start is tried, so many in all; if none reaches
# LEAST there is no model, provided each label has so many documents kept back.
KEPT_BACK = 4
GOOD, LEAST, STARTS, ENOUGH = 0.9, 0.6, 3, 20

WORD_BITS, CHAR_BITS = 15, 15
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 10
CHAR_ORDER = 4

# Bytes of text that are looked at together, and windows that are scored together.
_SLICE = 1 << 20
_WINDOWS = 2048
_BATCH = 512

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = True

_POWERS = np.cumprod(np.full(256, 0x01000193, np.uint32), dtype=np.uint32) | np.uint32(1)


@dataclass
class Words:
    """Words of a stretch of text: the bucket of each among words and among
    n-grams, the buckets of its character n-grams one word after another, and where
    each word's begin."""

    bucket: np.ndarray
    whole: np.ndarray
    grams: np.ndarray
    begins: np.ndarray
    starts: np.ndarray  # byte where each word begins

    @property
    def counts(self) -> np.ndarray:
        return np.diff(np.append(self.begins, len(self.grams)))


def _hashed(h: np.ndarray, bits: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return (h * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)).astype(np.int64)


def words_of(raw: np.ndarray) -> Words:
    """Words are runs of letters, digits and apostrophes, ASCII in lower case. Each
    is padded by its bounds, so n-grams tell where in a word they stand; the whole
    word counts as its own last n-gram."""
    low = lower_ascii(raw)
    inside = _IN_WORD[low]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edges[::2], edges[1::2]
    lengths = ends - starts
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none)
    # Each word with one bound before and one after it, all in one row.
    padded = lengths + 2
    begins = np.cumsum(padded) - padded
    line = np.zeros(int(padded.sum()), np.uint32)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    line[np.repeat(begins + 1, lengths) + place] = low[np.repeat(starts, lengths) + place]
    position = np.arange(len(line)) - np.repeat(begins, padded)
    bucket = np.add.reduceat(line * _POWERS[position % 256], begins, dtype=np.uint32)
    h = np.full(len(line), CHAR_ORDER, np.uint32)
    for k in range(CHAR_ORDER):
        h[: len(line) - k] = h[: len(line) - k] * np.uint32(0x01000193) + line[k:]
    counts = np.maximum(padded - CHAR_ORDER + 1, 0)
    return Words(
        _hashed(bucket, WORD_BITS),
        _hashed(bucket + np.uint32(77), CHAR_BITS),
        _hashed(h[position < np.repeat(counts, padded)], CHAR_BITS),
        np.cumsum(counts) - counts,
        starts,
    )


def window_starts(words: int) -> np.ndarray:
    """First words of overlapping windows that together hold every word."""
    if words <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, words - WINDOW, STRIDE), words - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters by name. Of the gates the first two thirds are reset and update,
    the last is the candidate; directions are stacked first."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 3) -> Network:
        draw = np.random.default_rng(seed)
        size = WORD_DIM + CHAR_DIM

        def normal(*shape: int, scale: float) -> np.ndarray:
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        return cls(
            {
                "word": normal(1 << WORD_BITS, WORD_DIM, scale=0.1),
                "char": normal(1 << CHAR_BITS, CHAR_DIM, scale=0.1),
                "wx": normal(2, size, 3 * HIDDEN, scale=size**-0.5),
                "wh": normal(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
                "bh": np.zeros((2, 3 * HIDDEN), np.float32),
                "att": normal(2 * HIDDEN, scale=0.3),
                "out": normal(2 * HIDDEN, scale=0.3),
                "bias": np.zeros(1, np.float32),
                "calibration": np.array([1.0, 0.0], np.float32),
            }
        )

    def inputs(self, words: Words) -> np.ndarray:
        x = np.empty((len(words.bucket), WORD_DIM + CHAR_DIM), np.float32)
        if not len(x):
            return x
        x[:, :WORD_DIM] = self.p["word"][words.bucket]
        counts, sums = words.counts, self.p["char"][words.whole]
        some = np.flatnonzero(counts)
        if len(some):
            sums[some] += np.add.reduceat(
                self.p["char"][words.grams], words.begins[some], axis=0
            )
        x[:, WORD_DIM:] = sums / np.sqrt(counts + 1)[:, None].astype(np.float32)
        return x

    def run(self, x: np.ndarray, held: np.ndarray, keep: bool = False):
        """Logits of windows ``x`` (window, word, input); ``held`` marks real words.

        The recurrence goes over words, for all windows at once.
        """
        p, n, h = self.p, len(x), HIDDEN
        steps = x.shape[1]
        states = np.empty((2, steps, n, h), np.float32)
        kept = []
        for d in range(2):
            inputs = (x.reshape(-1, x.shape[2]) @ p["wx"][d] + p["bh"][d]).reshape(n, steps, 3 * h)
            inputs = np.ascontiguousarray(inputs.transpose(1, 0, 2))
            state = np.zeros((n, h), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                through = state @ p["wh"][d]
                gates = _sigmoid(inputs[t, :, : 2 * h] + through[:, : 2 * h])
                r, z = gates[:, :h], gates[:, h:]
                c = np.tanh(inputs[t, :, 2 * h :] + r * through[:, 2 * h :])
                on = held[:, t, None]
                new = np.where(on, z * state + (1 - z) * c, state)
                if keep:
                    kept.append((d, t, state, through[:, 2 * h :], r, z, c))
                states[d, t] = state = new
        both = np.concatenate([states[0], states[1]], axis=2)  # word, window, 2 h
        pull = both @ p["att"]
        pull = np.where(held.T, pull, -1e9)
        weight = np.exp(pull - pull.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, both)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, both, weight, pooled, kept) if keep else logit

    def gradients(self, x: np.ndarray, held: np.ndarray, target: np.ndarray, worth: np.ndarray):
        """Of the weighted logistic loss: by parameter, and by input."""
        p, h = self.p, HIDDEN
        logit, both, weight, pooled, kept = self.run(x, held, keep=True)
        g = {name: np.zeros_like(v) for name, v in p.items() if name not in ("word", "char")}
        d_logit = ((_sigmoid(logit) - target) * worth / max(worth.sum(), 1)).astype(np.float32)
        g["out"] = pooled.T @ d_logit
        g["bias"][0] = d_logit.sum()
        d_pooled = d_logit[:, None] * p["out"]
        d_both = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tnk,nk->tn", both, d_pooled)
        d_pull = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att"] = np.einsum("tn,tnk->k", d_pull, both)
        d_both += d_pull[:, :, None] * p["att"]
        d_in = [np.zeros((x.shape[1], len(x), 3 * h), np.float32) for _ in range(2)]
        carry = [np.zeros((len(x), h), np.float32) for _ in range(2)]
        for d, t, state, inner, r, z, c in reversed(kept):
            total = d_both[t, :, d * h : (d + 1) * h] + carry[d]
            on = held[:, t, None]
            moved = np.where(on, total, 0)
            d_c = moved * (1 - z) * (1 - c * c)
            d_z = moved * (state - c) * z * (1 - z)
            d_r = d_c * inner * r * (1 - r)
            d_through = np.concatenate([d_r, d_z, d_c * r], axis=1)
            d_in[d][t] = np.concatenate([d_r, d_z, d_c], axis=1)
            g["wh"][d] += state.T @ d_through
            carry[d] = np.where(on, total * z, total) + d_through @ p["wh"][d].T
        d_x = np.zeros_like(x)
        flat = x.transpose(1, 0, 2).reshape(-1, x.shape[2])
        for d in range(2):
            of = d_in[d].reshape(-1, 3 * h)
            g["wx"][d] = flat.T @ of
            g["bh"][d] = of.sum(axis=0)
            d_x += (of @ p["wx"][d].T).reshape(x.shape[1], len(x), -1).transpose(1, 0, 2)
        return g, d_x


def _windowed(rows: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Word numbers of windows, from ``first`` on and below ``last``."""
    index = first[:, None] + np.arange(WINDOW)
    held = index < last[:, None]
    return np.minimum(index, max(len(rows) - 1, 0)), held


class _Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.step, self.m, self.v = rate, 0, {}, {}

    def move(self, name: str, value: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        m = self.m.setdefault(name, np.zeros_like(value))
        v = self.v.setdefault(name, np.zeros_like(value))
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        fix = np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        value[rows] -= self.rate * fix * m[rows] / (np.sqrt(v[rows]) + 1e-7)


def train(
    texts: list[bytes],
    labels: list[int],
    toxic_share: float | None = None,
    seed: int = 5,
) -> Network:
    """The first network of a few starts that tells the documents kept back apart, or
    the best of them; an error if none does at all."""
    best, reached = None, -1.0
    for start in range(STARTS):
        net, order, enough = _trained(texts, labels, toxic_share, seed + start)
        if order > reached:
            best, reached = net, order
        if reached >= GOOD or not enough:
            break
    if best is None or (enough and reached < LEAST):
        raise RuntimeError(
            f"toxicity: of {STARTS} trainings the best orders {max(reached, 0):.2f} of the "
            "pairs kept back; nothing can be rejected by it"
        )
    return best


def _ordered(score: np.ndarray, label: np.ndarray) -> float:
    """The share of pairs with unlike labels whose scores are in order; ties half."""
    if not np.isfinite(score).all():
        return -1.0
    low, high = np.sort(score[label == 0]), score[label == 1]
    if not len(low) or not len(high):
        return 0.5
    below = np.searchsorted(low, high, "left") + np.searchsorted(low, high, "right")
    return float(below.mean() / (2 * len(low)))


def _trained(
    texts: list[bytes], labels: list[int], toxic_share: float | None, seed: int
) -> tuple[Network, float, bool]:
    """A network fitted by the documents' labels alone, and calibrated to the share
    of toxic documents where that is known; how well it orders the documents kept back
    (-1 where any number is not finite), and whether they are enough to tell.

    In the first epochs every window has its document's label. After them a toxic
    document teaches by its worst window only, a clean one by its worst and one
    other, so that clean windows of toxic documents no longer count.
    """
    net = Network.fresh(seed - 2)
    if len(set(labels)) < 2:
        net.p["bias"][0] = 4.0 if labels and labels[0] else -4.0
        net.p["out"][:] = 0
        return net, 0.5, False
    words, doc, first, last = [], [], [], []
    at = 0
    for i, text in enumerate(texts):
        found = words_of(np.frombuffer(text, np.uint8))
        n = len(found.bucket)
        if not n:
            continue
        starts = window_starts(n)
        words.append(found)
        doc += [i] * len(starts)
        first += (at + starts).tolist()
        last += [at + n] * len(starts)
        at += n
    shift = np.cumsum([0, *[len(w.grams) for w in words]])
    every = Words(
        np.concatenate([w.bucket for w in words]),
        np.concatenate([w.whole for w in words]),
        np.concatenate([w.grams for w in words]),
        np.concatenate([w.begins + s for w, s in zip(words, shift[:-1], strict=True)]),
        np.zeros(0, np.int64),
    )
    doc, first, last = np.array(doc), np.array(first), np.array(last)
    target = np.array(labels, np.float32)[doc]
    many = np.bincount(doc, minlength=len(texts))[doc]
    draw, adam = np.random.default_rng(seed), _Adam(0.01)
    kept_back = np.arange(len(texts)) % KEPT_BACK == 0
    learnable = ~kept_back[doc]

    def batch_words(index: np.ndarray) -> tuple[Words, np.ndarray]:
        used, place = np.unique(index, return_inverse=True)
        lengths = every.counts[used]
        before = np.cumsum(lengths) - lengths
        own = np.repeat(every.begins[used] - before, lengths) + np.arange(int(lengths.sum()))
        return Words(every.bucket[used], every.whole[used], every.grams[own], before, used), place

    def learn(chosen: np.ndarray, worth: np.ndarray) -> None:
        for at in range(0, len(chosen), 128):
            mine = chosen[at : at + 128]
            index, held = _windowed(every.bucket, first[mine], last[mine])
            some, place = batch_words(index)
            x = net.inputs(some)[place].reshape(*index.shape, -1)
            g, d_x = net.gradients(x, held, target[mine], worth[at : at + 128])
            d_words = np.zeros((len(some.bucket), x.shape[2]), np.float32)
            np.add.at(d_words, place.ravel(), (d_x * held[:, :, None]).reshape(-1, x.shape[2]))
            adam.step += 1
            for name, grad in g.items():
                if name != "calibration":
                    adam.move(name, net.p[name], np.clip(grad, -1, 1))
            counts = some.counts
            d_char = d_words[:, WORD_DIM:] / np.sqrt(counts + 1)[:, None].astype(np.float32)
            each = np.concatenate([np.repeat(d_char, counts, axis=0), d_char])
            for name, buckets, grad in (
                ("word", some.bucket, d_words[:, :WORD_DIM]),
                ("char", np.concatenate([some.grams, some.whole]), each),
            ):
                rows, where = np.unique(buckets, return_inverse=True)
                summed = np.zeros((len(rows), grad.shape[1]), np.float32)
                np.add.at(summed, where, grad)
                adam.move(name, net.p[name], summed, rows)

    def logits() -> np.ndarray:
        out = np.empty(len(first), np.float32)
        for at in range(0, len(first), _BATCH):
            mine = slice(at, at + _BATCH)
            index, held = _windowed(every.bucket, first[mine], last[mine])
            some, place = batch_words(index)
            out[mine] = net.run(net.inputs(some)[place].reshape(*index.shape, -1), held)
        return out

    toxic = min(max(target.mean(), 1e-3), 0.999)
    batches = -(-3 * len(texts) // (2 * 128))
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-LEAST_STEPS // batches)))
    for epoch in range(epochs):
        if epoch < 2:
            # As many windows of each label; of long documents each counts less.
            worth = learnable / np.sqrt(many) / np.where(target > 0, toxic, 1 - toxic)
            chosen = draw.choice(len(doc), min(len(doc), 3000), p=worth / worth.sum())
            learn(chosen, np.ones(len(chosen), np.float32))
            continue
        score = logits() + draw.random(len(doc)) * 1e-6
        order = np.lexsort((-score, doc))
        worst = order[np.append(True, np.diff(doc[order]) > 0)]
        worst = worst[learnable[worst]]
        clean = np.flatnonzero(learnable & (target == 0) & (score > np.median(score)))
        other = draw.choice(clean, min(len(clean), len(worst) // 2), replace=False)
        chosen = draw.permutation(np.concatenate([worst, other]))
        share = min(max(target[chosen].mean(), 1e-3), 0.999)
        learn(chosen, np.where(target[chosen] > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32))
        if epoch == epochs - 5:
            adam.rate /= 3
    # Of documents it hasn't learned from, if they have both labels.
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, doc, logits())
    seen = np.bincount(doc, minlength=len(texts)) > 0
    label = np.array(labels)
    if len(set(label[seen & kept_back])) == 2:
        seen &= kept_back
    finite = np.isfinite(worst[seen]).all() and all(np.isfinite(v).all() for v in net.p.values())
    if not finite:
        return net, -1.0, True
    net.p["calibration"] = _calibration(worst[seen], label[seen].astype(float), toxic_share)
    enough = min(np.bincount(label[seen & kept_back], minlength=2)) >= ENOUGH
    return net, _ordered(worst[seen], label[seen]), bool(enough)


def _calibration(score: np.ndarray, label: np.ndarray, toxic_share: float | None) -> np.ndarray:
    """Slope and shift of the logistic curve through the documents' worst logits,
    each label weighing as much as its share of all labels."""
    own = label.mean()
    share = own if toxic_share is None else min(max(toxic_share, 0.01), 0.99)
    worth = np.where(label > 0, share / max(own, 1e-3), (1 - share) / max(1 - own, 1e-3))
    design = np.stack([score, np.ones_like(score)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Newton; the slope is drawn a little to 1
        p = _sigmoid(design @ w)
        pull = design.T @ (worth * (p - label)) + np.array([0.5 * (w[0] - 1), 1e-3 * w[1]])
        bend = (design * (worth * p * (1 - p))[:, None]).T @ design + np.diag([0.5, 1e-3])
        w -= np.clip(np.linalg.solve(bend, pull), -1, 1)
    return np.array([max(w[0], 0.1), w[1]], np.float32)


def worst_windows(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The highest window logit of each text; of one without a word the lowest
    number. Long texts are walked in slices that overlap by a window."""
    best = np.full(len(offsets) - 1, -np.inf, np.float32)
    for rows, part, places in _slices(raw, offsets):
        words = words_of(part)
        x = net.inputs(words)
        cuts = np.searchsorted(words.starts, places)
        first, last, owner = [], [], []
        for row, a, b in zip(rows, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < b:
                starts = window_starts(b - a) + a
                first.append(starts)
                last.append(np.full(len(starts), b))
                owner.append(np.full(len(starts), row))
        if not first:
            continue
        first, last, owner = map(np.concatenate, (first, last, owner))
        # Windows of like length go together, cut to the longest of them.
        lengths = np.minimum(last - first, WINDOW)
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), _WINDOWS):
            mine = order[at : at + _WINDOWS]
            index, held = _windowed(words.bucket, first[mine], last[mine])
            most = int(lengths[mine].max())
            logit = net.run(x[index[:, :most]], held[:, :most])
            np.maximum.at(best, owner[mine], logit)
    return best


def _slices(
    raw: np.ndarray, offsets: np.ndarray
) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Row numbers, bytes, and places of the rows in them: whole texts together,
    or one stretch of a long text. Each text ends outside any word of the next."""
    rows, parts, size = [], [], 0

    def together():
        line = np.concatenate([p for part in parts for p in (part, np.array([32], np.uint8))])
        places = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
        return rows, line, places

    for row, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = start
        while at < end:
            stop = min(at + _SLICE, end)
            if stop < end:
                blank = np.flatnonzero(~_IN_WORD[raw[at:stop]])
                stop = at + int(blank[-1]) + 1 if len(blank) else stop
            if size + stop - at > _SLICE and rows:
                yield together()
                rows, parts, size = [], [], 0
            rows.append(row)
            parts.append(raw[at:stop])
            size += stop - at
            if stop == end:
                break
            # The next stretch repeats the last window's words.
            blank = np.flatnonzero(~_IN_WORD[raw[at:stop]])
            back = at + int(blank[-min(len(blank), 2 * WINDOW)]) if len(blank) else stop
            at = back if back > at + _SLICE // 2 else stop
    if rows:
        yield together()


def learn_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_label: int = ROWS_PER_LABEL,
) -> Network:
    """A network fitted on at most ``per_label`` labelled rows of either label
    among those to ``learn`` from, a condition on ``key``; ids without a label teach
    nothing."""
    known = labels_of(docs, labels, "toxic", learn, id_col)
    sample = labelled_sample(docs, known, per_label, id_col, text_col)
    share = known.agg(F.avg("label")).first()[0]
    return train([raw for _, raw in sample], [int(label) for label, _ in sample], share)


def toxicity_of(text: Column, net: Network) -> Column:
    """Score from 0 to 1 of a text; null, empty and wordless texts score 0."""

    @F.arrow_udf("double")
    def of_batch(column: pa.Array) -> pa.Array:
        raw, offsets = bytes_and_offsets(column)
        worst = worst_windows(net, raw, offsets)
        slope, shift = net.p["calibration"]
        wordless = worst == -np.inf
        score = _sigmoid(np.where(wordless, 0, worst) * slope + shift).astype(float)
        if not np.isfinite(score).all():
            raise ValueError("toxicity: a score is not a number")
        return pa.array(np.where(wordless, 0.0, score))

    return of_batch.asNondeterministic()(text)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    learn = fold_of(F.col("key"), FOLDS) != 0
    net = learn_toxicity(docs, read_table(spark, sf_dir, "labels"), learn)
    scored = docs.select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        toxicity_of(F.col("text"), net).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
