"""Language identification by error-correcting output codes.

Every language has a codeword. One logistic classifier over hashed byte n-grams
predicts each bit; the language whose codeword costs least, each bit weighted by how
well it was learned, is chosen, and flagged where another costs hardly more.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import bytes_and_offsets, fold_of, read_table
from curbside.llm.ngrams import Grams, labelled_sample, shares, table_sums

UNKNOWN = "und"
FAMILIES = (Grams(2, 11, "lower"), Grams(3, 12, "lower"))
FOLDS = 5

# Training rows of each language, and of all; the classifiers see no more.
ROWS_PER_LANGUAGE, ROWS = 400, 4_000
# One row in so many of a language weighs the bits instead of teaching them.
HELD_BACK = 4
AMBIGUOUS_BELOW = 0.6


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # language x bit, 1 or -1
    tables: list[np.ndarray]  # for each family, bucket x bit
    bias: np.ndarray
    weights: np.ndarray  # of the bits


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """All splits of up to five languages in two; for more, of some hundred random
    codes the one whose nearest words are farthest apart."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        numbers = np.arange(1, 2 ** (languages - 1))
        bits = numbers[None, :] >> np.arange(languages)[:, None] & 1
        return np.where(bits, 1.0, -1.0)
    length = int(np.ceil(10 * np.log2(languages)))
    draws = np.random.default_rng(seed)
    best, widest = None, -1.0
    for _ in range(200):
        code = draws.choice([-1.0, 1.0], (languages, length))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        apart = (code.shape[1] - code @ code.T) / 2
        nearest = apart[~np.eye(languages, dtype=bool)].min()
        if nearest > widest:
            best, widest = code, nearest
    return best


def _logistic(
    x: np.ndarray, y: np.ndarray, taught: np.ndarray, steps: int = 150, decay: float = 1e-4
):
    """Weights and bias of one logistic classifier per column of ``y`` (1 or -1),
    by full-batch Adam on the rows that are ``taught``."""
    share = (taught / max(taught.sum(), 1)).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    b = np.zeros(y.shape[1], np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, steps + 1):
        margin = y * (x @ w + b)
        pull = (-y / (1 + np.exp(np.clip(margin, -30, 30)))).astype(np.float32) * share
        for value, grad, m, v in (
            (w, x.T @ pull + decay * w, moments[0], moments[1]),
            (b, pull.sum(axis=0), moments[2], moments[3]),
        ):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= (
                0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            ).astype(np.float32)
    return w, b


def train(texts: Sequence[bytes], languages: Sequence[str]) -> LanguageModel:
    names = sorted(set(languages))
    codes = codewords(len(names))
    if not len(texts):
        tables = [np.zeros((g.buckets, 1), np.float32) for g in FAMILIES]
        return LanguageModel([], np.ones((0, 1)), tables, np.zeros(1), np.ones(1))
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    x = np.hstack(shares(raw, offsets, FAMILIES))
    scale = (1 / (x.std(axis=0) + 1e-3)).astype(np.float32)
    x *= scale
    y = codes[[names.index(n) for n in languages]].astype(np.float32)
    # A bit weighs what its classifier gets right on rows it has not seen; each language
    # with four rows or more keeps some back.
    places = defaultdict(count)
    back = np.array([next(places[name]) % HELD_BACK == HELD_BACK - 1 for name in languages])
    w, b = _logistic(x, y, ~back)
    judged = back if back.any() else ~back
    right = ((x @ w + b > 0) == (y > 0))[judged]
    w, b = _logistic(x, y, np.ones(len(x), bool))
    weights = np.clip(right.mean(axis=0) - 0.5, 0.01, None)
    w = w * scale[:, None]
    cuts = np.cumsum([g.buckets for g in FAMILIES])[:-1]
    return LanguageModel(names, codes, np.split(w, cuts), b, weights / weights.sum())


def predict(model: LanguageModel, raw: np.ndarray, offsets: np.ndarray):
    """Place of the best language, its score, and whether another is near."""
    rows = len(offsets) - 1
    if not model.languages:
        return np.zeros(rows, int), np.zeros(rows), np.ones(rows, bool)
    margins = table_sums(raw, offsets, FAMILIES, model.tables) + model.bias
    # rows x languages: the weighted logistic loss of each codeword.
    loss = np.stack(
        [(np.logaddexp(0, -margins * code) * model.weights).sum(axis=1) for code in model.codes],
        axis=1,
    )
    bits = model.codes.shape[1]
    odds = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * bits)
    odds /= odds.sum(axis=1, keepdims=True)
    best = odds.argmax(axis=1)
    score = odds[np.arange(rows), best]
    return best, score, score < AMBIGUOUS_BELOW


def learn_languages(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = ROWS_PER_LANGUAGE,
) -> LanguageModel:
    """A model of at most ``per_language`` rows of each language, and ``ROWS`` in
    all, among the rows to ``learn`` from. Rows without a language teach nothing."""
    labelled = docs.filter(learn).select(
        F.col(id_col).alias("key"), F.col(lang_col).alias("label")
    )
    languages = labelled.filter("label IS NOT NULL").select("label").distinct().count()
    per_language = max(1, min(per_language, ROWS // max(languages, 1)))
    sample = labelled_sample(docs, labelled, per_language, id_col, text_col)
    return train([raw for _, raw in sample], [label for label, _ in sample])


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def language_of(text: Column, model: LanguageModel) -> Column:
    """A struct of ``lang``, ``score`` and ``ambiguous``.

    A null text, an empty one and one without a letter is ``und`` with score 0 and
    not ambiguous; so is every text where no language was learned.
    """

    @F.arrow_udf("struct<lang: string, score: double, ambiguous: boolean>")
    def of_batch(column: pa.Array) -> pa.Array:
        raw, offsets = bytes_and_offsets(column)
        best, score, ambiguous = predict(model, raw, offsets)
        names = np.array([*model.languages, UNKNOWN], object)
        chosen = names[best if model.languages else np.full(len(best), -1)]
        return pa.StructArray.from_arrays(
            [pa.array(chosen, pa.string()), pa.array(score), pa.array(ambiguous)],
            ["lang", "score", "ambiguous"],
        )

    unknown = F.struct(
        F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")
    )
    found = of_batch.asNondeterministic()(text)
    return F.when(has_letter(text), found).otherwise(unknown)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), FOLDS) == 0
    model = learn_languages(docs, ~held_out)
    found = docs.select(
        "doc_id", held_out.alias("held_out"), language_of(F.col("text"), model).alias("found")
    )
    return found.select(
        "doc_id",
        "held_out",
        F.col("found.lang").alias("lang_pred"),
        "found.score",
        "found.ambiguous",
    )
