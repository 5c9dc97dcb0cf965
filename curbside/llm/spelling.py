"""Spelling variants: words one edit apart, by walking a trie kept as a table.

The trie of all words is a distributed table of nodes with their edges. States (word,
position, node, edits) start on the word's own path and are joined with the node table
level by level: a state follows the edge of its word's next character, or spends its one
edit on another edge or on skipping a character. States that have spent it and come to
the end of a word have found a neighbour.

Two words one edit apart agree in their first or in their last half. So edits are made
in the second half only, once in the trie of the words and once in that of the reversed
words: the crowded nodes near the roots are never branched from. A node that only one
word lies below is not walked on: the rest of that word is compared by hash at once.
Every pair found is compared as text in the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import read_table, written
from curbside.llm.wordstream import Words, summed, text_spans, words_of

LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_RATIO = 10
SLIP = 31

# Bytes of the words that are hashed a byte of all at a time; longer ones singly.
_LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_after(state: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of what gave ``state`` followed by each stretch of bytes."""
    order = np.argsort(-lengths, kind="stable")
    crc, begins = ~state[order], starts[order]
    held = np.searchsorted(-lengths[order], -np.arange(1, _LONG + 1), "right")
    for k, many in enumerate(held.tolist()):
        if not many:
            break
        own = crc[:many]
        crc[:many] = _CRC[(own ^ raw[begins[:many] + k]) & 255] ^ (own >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in np.flatnonzero(lengths > _LONG):
        stretch = raw[starts[i] : starts[i] + lengths[i]].tobytes()
        out[i] = zlib.crc32(stretch, int(state[i]))
    return out


def letter_runs(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of A to Z and U+00C0 to U+00FF: in UTF-8 the latter are all the characters
    that begin with the byte C3."""
    low = raw | 32
    lead = raw == 0xC3
    inside = ((low >= 97) & (low <= 122)) | lead
    inside[1:] |= lead[:-1]
    return words_of(raw, offsets, inside)


def _slipped(words: Words, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which words lose a character, and the hashes that say which one. ``keys`` are
    the texts' ids with a colon."""
    lengths = pc.binary_length(words.distinct).to_numpy().astype(np.int64)[words.word]
    of_text = np.array([zlib.crc32(key) for key in keys], np.uint32)
    h = crc32_after(of_text[words.text], words.raw, words.starts, lengths)
    lost = np.flatnonzero(h % SLIP == 0)
    return lost, h[lost]


def _counted(words: Words, keys: list[bytes]) -> pa.Table:
    lost, h = _slipped(words, keys)
    kept = np.delete(words.word, lost)
    n = np.bincount(kept, minlength=len(words.distinct)).astype(np.int64)
    length = pc.utf8_length(words.distinct).to_numpy()
    good = pa.array((n > 0) & (length >= LEAST_LENGTH))
    long = length[words.word[lost]] > LEAST_LENGTH
    texts = words.distinct.take(pa.array(words.word[lost][long])).to_pylist()
    places = (h[long] % length[words.word[lost][long]]).tolist()
    cut = [w[:k] + w[k + 1 :] for w, k in zip(texts, places, strict=True)]
    whole = pa.table({"word": words.distinct.filter(good), "n": pa.array(n).filter(good)})
    other = pa.table({"word": pa.array(cut, pa.string()), "n": pa.array(np.ones(len(cut), np.int64))})
    return pa.concat_tables([whole, other])


def spelled_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n`` of the words long enough. A word whose crc32 together with
    its document's id is divisible by ``SLIP`` loses one character."""

    def of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[pa.Table]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for lo, hi, raw, offsets in text_spans(batch.column(1)):
                    keys = [f"{'' if i is None else i}:".encode() for i in ids[lo:hi]]
                    yield _counted(letter_runs(raw, offsets), keys)

        for table in summed(tables(), ["word"], "n"):
            yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    texts = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    parts = texts.mapInArrow(of_task, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _node(way: Column, prefix: Column) -> Column:
    return F.xxhash64(way, prefix)


def _both_ways(words: DataFrame) -> DataFrame:
    ways = F.array(
        F.struct(F.lit(0).alias("way"), F.col("word").alias("path")),
        F.struct(F.lit(1).alias("way"), F.reverse("word").alias("path")),
    )
    return words.select("id", F.explode(ways).alias("w")).select("id", "w.way", "w.path")


def trie(paths: DataFrame) -> DataFrame:
    """Nodes that two paths or more lie below, from the depth where edits begin:
    ``node`` and its ``edges``, each with its character ('' where a path ends), the node
    it leads to, the paths below, and of a single one its ``id`` and the hash of what is
    left of it. A node has at most as many edges as there are characters."""
    first = F.lit(LEAST_LENGTH // 2)
    steps = paths.select(
        "id", "way", "path", F.explode(F.sequence(first, F.length("path"))).alias("depth")
    )
    prefix, depth = F.substring("path", 1, F.col("depth")), F.col("depth")
    edges = (
        steps.select(
            "id",
            _node(F.col("way"), prefix).alias("node"),
            F.substring("path", depth + 1, F.lit(1)).alias("char"),
            _node(F.col("way"), F.substring("path", F.lit(1), depth + 1)).alias("child"),
            F.xxhash64(F.substring("path", depth + 2, F.length("path"))).alias("tail"),
        )
        .groupBy("node", "char", "child")
        .agg(F.count(F.lit(1)).alias("below"), F.min("id").alias("id"), F.min("tail").alias("tail"))
    )
    out = F.struct("char", "child", "below", F.col("id").alias("other"), "tail")
    nodes = edges.groupBy("node").agg(F.collect_list(out).alias("edges"), F.sum("below").alias("below"))
    return nodes.filter("below > 1").select("node", "edges")


# What a state becomes at a node. An edge with one word below it, or at a word's end, is
# an answer; others go on. Skipping the last of equal characters stands for skipping any.
_GO = """
transform(filter(edges, e -> {when}), e -> struct(
  CAST({edits} AS INT) AS edits, e.child AS node, substring(rest, {skip}) AS rest,
  CASE WHEN e.char = '' OR e.below = 1 THEN e.other END AS other,
  e.below > 1 OR e.char = '' OR e.tail = xxhash64(substring(rest, {skip})) AS fits))
"""
_NEXT, _AFTER = "substring(rest, 1, 1)", "substring(rest, 2, 1)"
_MOVES = f"""
CASE WHEN edits = 1 THEN {_GO.format(when=f"e.char = {_NEXT}", edits=1, skip=2)}
WHEN rest = '' THEN array()
ELSE concat(
  {_GO.format(when=f"e.char = {_NEXT} AND e.below > 1", edits=0, skip=2)},
  {_GO.format(when=f"e.char > {_NEXT}", edits=1, skip=2)},
  {_GO.format(when=f"e.char = {_AFTER} AND {_NEXT} <> {_AFTER}", edits=1, skip=3)})
END
"""


def frontier_step(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """The states of the next level; those with an ``other`` have found it."""
    moved = states.join(nodes, "node").select("id", "pos", F.explode(F.expr(_MOVES)).alias("m"))
    return moved.filter("m.fits").select(
        "id", (F.col("pos") + 1).alias("pos"), "m.node", "m.edits", "m.rest", "m.other"
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of ids of ``words`` (``id``, ``word``) one edit apart, each
    once. As many levels are walked as two words have characters in common."""
    paths = _both_ways(words)
    nodes = written(trie(paths), "spelling-trie")
    half = F.floor(F.length("path") / 2).cast("int")
    states = paths.select(
        "id",
        half.alias("pos"),
        _node(F.col("way"), F.substring("path", F.lit(1), half)).alias("node"),
        F.lit(0).alias("edits"),
        F.substring("path", half + 1, F.length("path")).alias("rest"),
    )
    found = None
    while True:
        level = written(frontier_step(states, nodes), "spelling-frontier")
        states = level.filter("other IS NULL").drop("other")
        pairs = level.filter("other IS NOT NULL AND id <> other")
        pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        found = pairs if found is None else found.unionByName(pairs)
        if states.isEmpty():
            break
    left = words.select(F.col("id").alias("a"), F.col("word").alias("word_a"))
    right = words.select(F.col("id").alias("b"), F.col("word").alias("word_b"))
    texts = found.distinct().join(left, "a").join(right, "b")
    return texts.filter(F.levenshtein("word_a", "word_b", 2) == 1).select("a", "b")


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and the ``root`` its forms lead to. A form is ten times as frequent, so
    the way is short; each round doubles the steps taken."""
    roots = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = roots.join(on, "root", "left")
        moved = step.select("word", F.coalesce("further", "root").alias("root"), "further")
        moved = written(moved, "spelling-roots")
        roots = moved.select("word", "root")
        if moved.filter("further IS NOT NULL").isEmpty():
            return roots


def spelling_groups(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of each of
    ``words`` (``word``, ``n``; every word once, at least ``LEAST_LENGTH`` characters).
    Ties between forms go to the smaller word in code-point order; without a word there
    are no rows."""
    numbered = words.select(F.monotonically_increasing_id().alias("id"), "word", "n")
    numbered = written(numbered, "spelling-words")
    pairs = near_pairs(numbered)
    links = F.array(
        F.struct(F.col("a").alias("id"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("id"), F.col("a").alias("other")),
    )
    each = pairs.select(F.explode(links).alias("l")).select("l.id", "l.other")
    other = numbered.select(F.col("id").alias("other"), F.col("word").alias("w"), F.col("n").alias("m"))
    near = each.join(other, "other").groupBy("id").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("m")).alias("m"), "w")).alias("first"),
    )
    near = near.select("id", "n_near", F.col("first.w").alias("w"), (-F.col("first.m")).alias("m"))
    takes = F.col("m") >= ratio * F.col("n")
    formed = written(
        numbered.join(near, "id", "left").select(
            "word", "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(takes, F.col("w")).alias("form"),
            F.when(takes, F.col("m")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    docs: DataFrame, least: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """:func:`spelling_groups` of the words of documents that occur ``least`` times.

    A null text has no words, a null id counts as empty. Rows that repeat count again;
    other columns are not read; texts and words of any length are taken whole. Empty
    tables give no rows.
    """
    words = spelled_words(docs, id_col, text_col).filter(F.col("n") >= least)
    return spelling_groups(words)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))
