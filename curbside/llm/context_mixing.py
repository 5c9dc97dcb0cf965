"""Language-model scores by online logistic context mixing.

A token is coded as ``CODE_BITS`` binary decisions, the bits of its hash, and the choice
among the tokens with that code. Several predictors give each bit a probability from
what they have counted in their context: nothing, the token before, the two tokens
before (in hashed tables), and the same document up to here. Their logits are combined
by weights that a gate chooses by the bit's place and by how much each predictor has
seen; the result is refined by an adaptive map from predicted to observed probability.
The choice within a code goes by the counts of the tokens alone.

Everything is learned from all training texts. Tokens are counted by a shuffle. Then
each task goes through its texts online: it predicts a block of them from the contexts
it has counted so far, moves weights and map, and counts the block. What the tasks have
counted is added up; what they have learned is averaged by how much each has seen. The
tables have as many slots as the corpus has tokens up to a fixed number, so the model sent
to the tasks is bounded. The counts of the most frequent tokens are sent along; the
others' are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.bloom import mixed
from curbside.llm.common import fold_of, read_table, spans_of_rows, sums_by_row, written
from curbside.llm.wordstream import SPACES, hashes_of, summed, text_spans, word_bytes, words_of

FOLDS, HELD_OUT = 5, 1
CODE_BITS = 14
ORDERS = 2
# Slots of each order's table: a power of two, about as many as there are training tokens,
# since contexts that share a slot spoil each other's counts, up to what a task can hold.
LEAST_SLOT_BITS, MOST_SLOT_BITS = 14, 22
# Levels of a context whose slots lie side by side, so that memory is waited for once for
# all of them. A node's slot is that of the first level's node with the node's number among
# them, 1 to 7, in the last bits; what is hashed to a slot is spread over all as before.
NEAR = 3
CHUNK = 1 << 12  # slots that travel together
HEAD = 1 << 17  # most frequent tokens, whose counts every task has
END = ""  # the token after the last word; no word is empty

TRUST = 1.0  # weight of the context-free probability beside a context's counts
STEP, TOGETHER = 0.05, 8192  # of the online descent: its rate, tokens of one update
LIMIT, NOTCHES = 8.0, 33  # the refining map's range of logits, its points
LEAST_P = 2.0**-16

# Bytes of text that are encoded together, tokens whose decisions are worked out
# together: few enough to stay in a processor's cache.
_SPAN, _BLOCK = 2 << 20, 1 << 14

# Tokens whose words are looked up together in the head, as each lookup reads all of it.
_LOOKED_UP = 1 << 21

_INSIDE = word_bytes(SPACES).tobytes()
# How much a predictor has seen, in four levels: nothing, up to 2, up to 9, more.
_LEVELS = 4
_FROM = tuple(np.float32(least) for least in (1, 3, 10))
_GATES = CODE_BITS * _LEVELS**3
_MAPS = CODE_BITS * _LEVELS**2
_INPUTS = 2 + ORDERS
_START = np.array([0.3, 0.2, 0.2, 0.3], np.float32)


def codes_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CODE_BITS)).astype(np.int32)


class Tokens:
    """Tokens of some texts in order, each text's closed by ``END``: the ``text`` of
    each, its place among the ``distinct`` ones, their ``hashes`` and ``codes``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        words = words_of(raw, offsets, np.frombuffer(raw.tobytes().translate(_INSIDE), bool))
        texts = len(offsets) - 1
        held = np.bincount(words.text, minlength=texts)
        self.text = np.repeat(np.arange(texts), held + 1)
        self.bounds = np.append(0, np.cumsum(held + 1))
        self.token = np.full(len(self.text), len(words.distinct), np.int64)
        self.token[np.arange(len(words.word)) + words.text] = words.word
        self.distinct = pa.concat_arrays([words.distinct, pa.array([END])])

    @cached_property
    def _hashes(self) -> np.ndarray:
        return hashes_of(self.distinct)

    @cached_property
    def hashes(self) -> np.ndarray:
        return self._hashes[self.token]

    @cached_property
    def codes(self) -> np.ndarray:
        return codes_of(self._hashes)[self.token]

    def counts(self) -> pa.Table:
        n = np.bincount(self.token, minlength=len(self.distinct)).astype(np.int64)
        return pa.table({"token": self.distinct, "n": n})

    def blocks(self) -> Iterator[Block]:
        """Whole texts, some thousand tokens at a time."""
        for lo, hi in spans_of_rows(self.bounds, _BLOCK):
            first, last = self.bounds[lo], self.bounds[hi]
            part = slice(first, last)
            yield Block(self.codes[part], self.hashes[part], self.bounds[lo : hi + 1] - first)


@dataclass
class Block:
    codes: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    def contexts(self) -> list[np.ndarray]:
        """32-bit hashes of the one token before and of the two before, in the text."""
        out, before = [], np.zeros(len(self.codes), np.uint64)
        for order in range(1, ORDERS + 1):
            past = np.zeros(len(self.codes), np.uint64)
            past[order:] = self.hashes[:-order]
            for k in range(order):
                early = self.bounds[:-1] + k
                past[early[early < self.bounds[1:]]] = 0
            before = mixed(before * np.uint64(31) + past + np.uint64(order))
            out.append((before >> np.uint64(32)).astype(np.uint32))
        return out


def _slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    h = node.astype(np.uint32) * np.uint32(0x9E3779B1)
    h += context
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - bits)
    return h.astype(np.int64)


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``values`` at ``places``, 64-bit numbers within bounds: the only ones numpy looks
    up without converting or checking each."""
    return values.take(places, mode="clip")


def counts_so_far(codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level, of each token how often its document came to the same node
    before and went by 0, and by 1. Tokens are dealt by one bit after another, all with
    0 before all with 1 and else in order, so that those of one document and node lie
    together; ``lies`` is the place of each token, ``begin`` where its node begins."""
    n = len(codes)
    places = np.arange(n)
    lies, begin = places, np.repeat(bounds[:-1], np.diff(bounds))
    ones = np.zeros(n + 1, np.int64)
    for level in range(CODE_BITS):
        bit = (codes >> (CODE_BITS - level - 1)) & 1
        np.cumsum(bit, out=ones[1:])
        before = _at(ones, begin)
        own = ones[:-1] - before
        begin_0 = begin - before
        zeros = places - ones[:-1]
        yield _at((zeros - begin_0).astype(np.float32), lies), _at(own.astype(np.float32), lies)
        if level == CODE_BITS - 1:
            return
        up = bit.astype(bool)
        by_0, by_1 = np.flatnonzero(~up), np.flatnonzero(up)
        half = len(by_0)
        before += half
        own = ones[:-1] + half
        own -= zeros
        own *= bit
        own += zeros
        lies = _at(own, lies)
        codes = np.concatenate((_at(codes, by_0), _at(codes, by_1)))
        begin = np.concatenate((_at(begin_0, by_0), _at(before, by_1)))


@dataclass
class Counts:
    """What was counted: by node of the code's tree, and by slot of each order's table,
    the zeros and the ones, side by side since they are looked up together; by code the
    tokens and the distinct tokens."""

    nodes: np.ndarray  # 2, nodes
    tables: np.ndarray  # by order and slot, zeros as real and ones as imaginary part
    tokens: np.ndarray
    distinct: np.ndarray

    @property
    def bits(self) -> int:
        return int(self.tables.shape[1]).bit_length() - 1

    def priors(self, without_itself: bool) -> tuple[np.ndarray, np.ndarray]:
        """By node the context-free probabilities, laid out like the tables, and their
        logit, or by node and bit the same with one token that goes there taken out."""
        n = self.nodes
        if without_itself:
            n = np.repeat(n, 2, axis=1)
            n[0, ::2] -= 1
            n[1, 1::2] -= 1
            n = np.maximum(n, 0)  # where no token goes
        n = n + np.float32(0.5)
        part = np.float32(TRUST) / (n[0] + n[1])
        both = np.empty(len(part), np.complex64)
        both.real, both.imag = n * part
        return both, np.log(n[1] / n[0])


@dataclass
class Mixer:
    weights: np.ndarray  # by input and gate
    refined: np.ndarray  # sum of bits and number, by map and notch


def fresh_mixer() -> Mixer:
    centre = np.linspace(-LIMIT, LIMIT, NOTCHES)
    refined = np.full((2, _MAPS * NOTCHES), 2.0)
    refined[0] = np.tile(2.0 / (1 + np.exp(-centre)), _MAPS)
    return Mixer(np.repeat(_START[:, None], _GATES, axis=1), refined)


def _level_of(seen: np.ndarray) -> np.ndarray:
    level = (seen >= _FROM[0]).view(np.uint8)
    for least in _FROM[1:]:
        level += seen >= least
    return level


def decisions(block: Block, counts: Counts, priors: tuple[np.ndarray, np.ndarray], online: bool):
    """For each level the logits of the predictors (input, token), and of each token the
    gate and the map, both counted within the level, and the bit. ``online`` adds the
    block to the tables behind it; ``priors`` are then those without the token itself,
    since the counts by node are of all texts."""
    contexts, bits = block.contexts(), counts.bits
    codes = block.codes.astype(np.int64)
    for level, (zeros, ones) in enumerate(counts_so_far(codes, block.bounds)):
        left = CODE_BITS - level
        node = (codes >> left) + (1 << level)
        by_bit = (codes >> (left - 1)) + (2 << level)
        bit = by_bit & 1
        x = np.empty((_INPUTS, len(bit)), np.float32)
        place = by_bit if online else node
        prior = _at(priors[0], place)
        priors[1].take(place, mode="clip", out=x[0])
        below = level % NEAR
        if not below:
            roots = [_slots(context, node, bits) for context in contexts]
        within = node & ((1 << below) - 1)
        within += 1 << below
        seen = []
        # A context's counts with the context-free probabilities added.
        for order, root in enumerate(roots):
            slot = root ^ within
            counted = _at(counts.tables[order], slot)
            seen.append(_level_of(counted.real + counted.imag))
            counted += prior
            np.log(counted.imag / counted.real, out=x[1 + order])
            if online:
                slot += slot
                slot += bit
                np.add.at(counts.tables[order].view(np.float32), slot, np.float32(1))
        seen.append(_level_of(zeros + ones))
        ones += prior.imag
        zeros += prior.real
        np.log(ones / zeros, out=x[1 + ORDERS])
        near = seen[1]
        for other in seen[2:]:
            near = near * np.uint8(_LEVELS) + other
        gate = near * np.uint8(_LEVELS) + seen[0]
        yield x, gate.astype(np.int64), near.astype(np.int64), bit


def _logit(x: np.ndarray, weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """``weights`` by input, then gate."""
    total = _at(weights[0], gate)
    total *= x[0]
    for k in range(1, len(x)):
        more = _at(weights[k], gate)
        more *= x[k]
        total += more
    return total


def _notches(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.clip(logit, np.float32(-LIMIT), np.float32(LIMIT))
    at += np.float32(LIMIT)
    at *= np.float32((NOTCHES - 1) / (2 * LIMIT))
    low = np.minimum(at.astype(np.int32), np.int32(NOTCHES - 2))
    return low, at - low


def _sigmoid(x: np.ndarray) -> np.ndarray:
    p = np.float32(0.5) * x
    np.tanh(p, out=p)
    p *= np.float32(0.5)
    p += np.float32(0.5)
    return p


def _of_level(level: int, many: int) -> slice:
    return slice(level * many, (level + 1) * many)


class Learner:
    """Goes through the texts of one task, predicting each block before it counts it,
    by online descent with steps after each weight's own past gradients. ``counts`` are
    those of the nodes; its tables are filled here."""

    def __init__(self, counts: Counts) -> None:
        self.counts, self.mixer = counts, fresh_mixer()
        self.priors = counts.priors(without_itself=True)
        self.past = np.full((_INPUTS, _GATES), 1e-6)
        self.seen = np.zeros(_GATES)
        self.refined = np.zeros((2, _MAPS * NOTCHES))

    def learn(self, block: Block) -> None:
        many, maps = _GATES // CODE_BITS, _MAPS // CODE_BITS * NOTCHES
        steps = decisions(block, self.counts, self.priors, online=True)
        for level, (x, gate, near, bit) in enumerate(steps):
            logit = np.empty(len(bit), np.float32)
            mine = self.mixer.weights[:, _of_level(level, many)]
            past = self.past[:, _of_level(level, many)]
            for at in range(0, len(bit), TOGETHER):
                part = slice(at, at + TOGETHER)
                g, own = gate[part], x[:, part]
                logit[part] = _logit(own, mine, g)
                miss = (bit[part] - _sigmoid(logit[part])).astype(np.float64)
                pull = np.stack([np.bincount(g, miss * row, minlength=many) for row in own])
                past += pull * pull
                mine += (STEP * pull / np.sqrt(past)).astype(np.float32)
            self.seen[_of_level(level, many)] += np.bincount(gate, minlength=many)
            notch, part = _notches(logit)
            own = self.refined[:, _of_level(level, maps)]
            near *= NOTCHES
            near += notch
            near += part > 0.5
            near += near
            near += bit
            zeros, ones = np.bincount(near, minlength=2 * maps).reshape(-1, 2).T
            own[0] += ones
            own[1] += zeros + ones

    def sums(self) -> np.ndarray:
        """Weights times what they have seen, that, and the map's sums."""
        weights = self.mixer.weights * self.seen
        return np.concatenate([weights.ravel(), self.seen, self.refined.ravel()])


def mixer_of(line: np.ndarray) -> Mixer:
    """The mean of what the tasks have learned, from :meth:`Learner.sums` added up;
    what none has seen stays as it starts."""
    mixer = fresh_mixer()
    sums = line[: _GATES * _INPUTS].reshape(_INPUTS, _GATES)
    seen = line[_GATES * _INPUTS :][:_GATES]
    some = seen > 0
    mixer.weights[:, some] = sums[:, some] / seen[some]
    mixer.refined += line[_GATES * (_INPUTS + 1) :].reshape(2, _MAPS * NOTCHES)
    return mixer


def bit_scores(
    block: Block,
    counts: Counts,
    mixer: Mixer,
    priors: tuple[np.ndarray, np.ndarray] | None = None,
) -> np.ndarray:
    """log10 probability of each token's code. ``priors`` are those of ``counts``, for
    callers with many blocks."""
    priors = counts.priors(without_itself=False) if priors is None else priors
    many, maps = _GATES // CODE_BITS, _MAPS // CODE_BITS * NOTCHES
    whole = np.ones(len(block.codes))  # no less than LEAST_P ** CODE_BITS
    curve = (mixer.refined[0] / mixer.refined[1]).astype(np.float32)
    steps = decisions(block, counts, priors, online=False)
    for level, (x, gate, near, bit) in enumerate(steps):
        logit = _logit(x, mixer.weights[:, _of_level(level, many)], gate)
        mine = curve[_of_level(level, maps)]
        notch, part = _notches(logit)
        near *= NOTCHES
        near += notch
        low = _at(mine, near)
        near += 1
        more = _at(mine, near)
        more -= low
        p = part * more
        low += _sigmoid(logit)
        p += low
        p *= 0.5
        p -= 1 - bit  # the probability of the bit itself, or that less than zero
        np.abs(p, out=p)
        whole *= np.clip(p, LEAST_P, 1 - LEAST_P, out=p)
    return np.log10(whole)


def _over_tokens(docs: DataFrame, text_col: str, make, types: str) -> DataFrame:
    def of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans() -> Iterator[Tokens]:
            for batch in batches:
                for _, _, raw, offsets in text_spans(batch.column(0), _SPAN):
                    yield Tokens(raw, offsets)

        for table in make(spans()):
            yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    return docs.select(F.col(text_col).cast("string")).mapInArrow(of_task, types)


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``token``, its ``code`` and its occurrences ``n``."""

    def counted(spans: Iterator[Tokens]) -> Iterator[pa.Table]:
        for table in summed((t.counts() for t in spans), ["token"], "n"):
            codes = codes_of(hashes_of(table["token"].combine_chunks()))
            yield table.append_column("code", pa.array(codes.astype(np.int64)))

    parts = _over_tokens(docs, text_col, counted, "token string, n bigint, code bigint")
    return parts.groupBy("token", "code").agg(F.sum("n").alias("n"))


def _planes(values: np.ndarray) -> bytes:
    """32-bit counts, first all their low bytes: what is small packs well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def learned_online(docs: DataFrame, counts: Counts, text_col: str = "text") -> tuple[Counts, Mixer]:
    """The tables of ``counts``, which come empty, filled from all texts, and what was
    learned on the way. A task sends its tables in chunks, and its weights as one more;
    adding them up takes no more memory than the model."""
    shape = counts.tables.shape
    shared = docs.sparkSession.sparkContext.broadcast(
        (counts.nodes, counts.tokens, counts.distinct)
    )
    types = "chunk bigint, counts binary"

    def of_task(spans: Iterator[Tokens]) -> Iterator[pa.Table]:
        nodes, tokens, distinct = shared.value
        learner = Learner(Counts(nodes, np.zeros(shape, np.complex64), tokens, distinct))
        for block in (b for span in spans for b in span.blocks()):
            learner.learn(block)
        chunks = learner.counts.tables.view(np.float32).reshape(-1, CHUNK)
        for at in np.flatnonzero(chunks.any(axis=1)).tolist():
            yield pa.table({"chunk": pa.array([at]), "counts": pa.array([_planes(chunks[at])])})
        yield pa.table({"chunk": pa.array([-1]), "counts": pa.array([learner.sums().tobytes()])})

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                own = np.frombuffer(raw, np.float64) if at < 0 else _from_planes(raw)
                sums[at] = sums[at] + own if at in sums else own.astype(np.float64)
        for at, own in sums.items():
            own = own if at < 0 else own.astype(np.float32)
            yield pa.record_batch({"chunk": pa.array([at]), "counts": pa.array([own.tobytes()])})

    made = _over_tokens(docs, text_col, of_task, types)
    whole = made.repartition("chunk").mapInArrow(added, types).toArrow()
    tables, mixer = np.zeros_like(counts.tables), fresh_mixer()
    chunks = tables.view(np.float32).reshape(-1, CHUNK)
    for batch in whole.to_batches():
        for at, raw in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            if at < 0:
                mixer = mixer_of(np.frombuffer(raw, np.float64))
            else:
                chunks[at] = np.frombuffer(raw, np.float32)
    return Counts(counts.nodes, tables, counts.tokens, counts.distinct), mixer


@dataclass
class Model:
    """Learned from the training texts. ``vocabulary`` is the table of token counts;
    ``head`` and ``head_n`` repeat its most frequent tokens."""

    counts: Counts
    mixer: Mixer
    vocabulary: DataFrame
    head: pa.Array
    head_n: np.ndarray
    total: int
    distinct: int


def slot_bits(tokens: int) -> int:
    return min(max(math.ceil(math.log2(tokens + 1)), LEAST_SLOT_BITS), MOST_SLOT_BITS)


def learn_mixing(docs: DataFrame, text_col: str = "text") -> Model:
    """A model of the texts of ``docs``, nulls as empty; of no rows, one that holds all
    codes equally likely."""
    spark = docs.sparkSession
    vocabulary = written(token_counts(docs, text_col), "mixing-tokens")
    by_code = (
        vocabulary.groupBy("code").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    )
    tokens, distinct = np.zeros((2, 1 << CODE_BITS), np.int64)
    tokens[by_code["code"].to_numpy()] = by_code["n"].to_numpy()
    distinct[by_code["code"].to_numpy()] = by_code["v"].to_numpy()
    nodes = np.zeros((2, 1 << CODE_BITS), np.float32)
    for level in range(CODE_BITS):
        sums = tokens.reshape(2 << level, -1).sum(axis=1)
        nodes[0, 1 << level : 2 << level], nodes[1, 1 << level : 2 << level] = sums[::2], sums[1::2]
    total = int(tokens.sum())
    tables = np.zeros((ORDERS, 1 << slot_bits(total)), np.complex64)
    counts, mixer = learned_online(docs, Counts(nodes, tables, tokens, distinct), text_col)
    head = vocabulary.orderBy(F.desc("n"), "token").limit(HEAD).select("token", "n").toArrow()
    return Model(
        counts, mixer, vocabulary, head["token"].combine_chunks(), head["n"].to_numpy(),
        total, int(distinct.sum()),
    )


def in_head(spans: Iterable[tuple], head: pa.Array) -> Iterator[tuple]:
    """Spans, whose last field is their :class:`Tokens`, and behind it the place of each
    distinct one in ``head``, or -1."""
    spans = iter(spans)
    while True:
        some, held = [], 0
        for span in spans:
            some.append(span)
            held += len(span[-1].token)
            if held >= _LOOKED_UP:
                break
        if not some:
            return
        place = pc.index_in(pa.concat_arrays([s[-1].distinct for s in some]), value_set=head)
        place = place.fill_null(-1).to_numpy()
        while some:
            span = some.pop(0)
            many = len(span[-1].distinct)
            yield *span, place[:many]
            place = place[many:]


def score_texts(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """For each row ``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score``
    (log10), ``n_bytes`` and ``bits_per_byte`` (null for empty texts).

    Rows keep apart whatever their ids. Each task scores whole texts with the model
    and the head's counts, and sends on the tokens beyond the head, whose counts are
    joined: those are rare, so no key is hot.
    """
    spark = docs.sparkSession
    counts = model.counts
    within = np.log10(counts.tokens + 0.5 * (counts.distinct + 1))
    shared = spark.sparkContext.broadcast(
        (counts, model.mixer, model.head, np.log10(model.head_n + 0.5), within)
    )

    def of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mixer, head, weight, within = shared.value
        priors = counts.priors(without_itself=False)
        key = TaskContext.get().partitionId() << 33
        spans = (
            (batch.column(0).slice(lo, hi - lo), offsets, Tokens(raw, offsets))
            for batch in batches
            for lo, hi, raw, offsets in text_spans(batch.column(1), _SPAN)
        )
        for ids, offsets, tokens, place in in_head(spans, head):
            known = place[tokens.token] >= 0
            value = np.concatenate([bit_scores(b, counts, mixer, priors) for b in tokens.blocks()])
            value = value - within[tokens.codes]
            mass = np.zeros(len(known))
            mass[known] = weight[place[tokens.token[known]]]
            texts = len(ids)
            keys = key + np.arange(texts)
            key += texts
            yield pa.record_batch({
                "key": pa.array(keys),
                "id": ids,
                "token": pa.nulls(texts, pa.string()),
                "n": pa.array(np.diff(tokens.bounds)),
                "n_known": pa.array(sums_by_row(known.astype(float), tokens.bounds).astype(np.int64)),
                "mass": pa.array(sums_by_row(mass, tokens.bounds)),
                "value": pa.array(sums_by_row(value, tokens.bounds)),
                "n_bytes": pa.array(np.diff(offsets)),
            })
            many = len(tokens.distinct)
            rare = np.sort(tokens.text[~known] * many + tokens.token[~known])
            first = np.flatnonzero(np.append(True, rare[1:] != rare[:-1])[: len(rare)])
            n, rare = np.diff(np.append(first, len(rare))), rare[first]
            none = pa.nulls(len(rare), pa.int64())
            yield pa.record_batch({
                "key": pa.array(keys[rare // many]),
                "id": none.cast(ids.type),
                "token": tokens.distinct.take(pa.array(rare % many)),
                "n": pa.array(n),
                "n_known": none,
                "mass": none.cast(pa.float64()),
                "value": none.cast(pa.float64()),
                "n_bytes": none,
            })

    texts = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = texts.schema[0].dataType.simpleString()
    rows = written(
        texts.mapInArrow(
            of_task,
            f"key bigint, id {kind}, token string, n bigint, n_known bigint, mass double,"
            " value double, n_bytes bigint",
        ),
        "mixing-scores",
    )
    mine = F.log10(F.coalesce(F.col("m"), F.lit(0)) + 0.5)
    vocabulary = model.vocabulary.select(F.col("token"), F.col("n").alias("m"))
    rare = (
        rows.filter("token IS NOT NULL").select("key", "token", "n").join(vocabulary, "token", "left")
        .groupBy("key").agg(
            F.sum(F.col("n") * mine).alias("more"),
            F.sum(F.when(F.col("m") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        )
    )
    whole = math.log10(model.total + 0.5 * (model.distinct + 1))
    mass = F.col("mass") + F.coalesce("more", F.lit(0.0))
    scored = rows.filter("token IS NULL").join(rare, "key", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (mass - F.col("n") * whole).alias("base_score"),
        (mass + F.col("value")).alias("score"),
        "n_bytes",
    )
    bits = -F.col("score") / math.log10(2)
    return scored.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")))


def scored_by_the_rest(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """:func:`score_texts` of all rows by a model of those that are not ``held_out`` (a
    condition on the id, never null).

    Null and empty texts consist of ``END`` alone. Rows that repeat count and are scored
    again; texts of any length are scored whole; other columns are not read; without
    rows there are none.
    """
    model = learn_mixing(docs.filter(~held_out), text_col)
    scored = score_texts(docs, model, id_col, text_col)
    return scored.select(
        F.col(id_col), held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score",
        "n_bytes", "bits_per_byte",
    )


def op13_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored_by_the_rest(docs, fold_of(F.col("doc_id"), FOLDS) == HELD_OUT)
