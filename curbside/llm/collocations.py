"""Collocations: phrases of two to four words whose halves seldom occur apart.

Stripes: each prefix of one to three words keys a counter of the words that follow it.
A task makes stripes of the texts it reads, a shuffle brings those of one prefix
together in order, and they are merged element by element as they stream by. One table
of merged stripes then gives everything: a prefix's own occurrences are the sum of its
stripe, a longer phrase's are an element of it, and the largest element says how often
the prefix is part of something longer.

A phrase that occurs often enough consists of words, pairs and triples that do. So words
are counted first, then stripes are made of prefixes of one, two and three words in
turn, each time of frequent prefixes only. Tasks know the frequent ones by a Bloom filter
of bounded size: what it lets through wrongly is counted and dropped. The stripes of
prefixes that occur very often are cut into segments by the word that follows, for they
may hold most other words; which those are, tasks know in the same way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbside.llm.bloom import Bloom, bloom_of, joined
from curbside.llm.common import bytes_and_offsets, read_table, written
from curbside.llm.wordstream import BLANKS, hashes_of, summed, text_spans, word_bytes, words_of

LEAST = 30
MOST_WORDS = 4
PER_LANGUAGE = 2_000
UNKNOWN = "und"

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"

# Occurrences from which a prefix's stripe is cut, and into how many segments.
HOT, SEGMENTS = 1 << 16, 64

_INSIDE = word_bytes(BLANKS + PIECE_ENDS)
_ENDS = ~word_bytes(PIECE_ENDS)
_NONE = "\n"  # follows a prefix where no frequent word does; no word contains it

# A stripe on its way: the words that follow between blanks, and their counts as
# unsigned 32-bit integers. Far smaller than arrays where most have one or two.
_STRIPE = pa.schema(
    [
        ("lang", pa.string()),
        ("prefix", pa.string()),
        ("segment", pa.int32()),
        ("nexts", pa.string()),
        ("counts", pa.binary()),
    ]
)
_STRIPE_TYPES = "lang string, prefix string, segment int, nexts string, counts binary"


class _Span:
    """Words of some texts as numbers of the distinct (language, word) among them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: pa.Array) -> None:
        words = words_of(raw, offsets, _INSIDE[raw])
        langs = langs.fill_null(UNKNOWN).dictionary_encode()
        lang_of = langs.indices.to_numpy()[words.text].astype(np.int64)
        both, self.word, self.counts = np.unique(
            lang_of * max(len(words.distinct), 1) + words.word,
            return_inverse=True, return_counts=True,
        )
        own = both % max(len(words.distinct), 1)
        self.lang = langs.dictionary.take(pa.array(both // max(len(words.distinct), 1)))
        self.text = words.distinct.take(pa.array(own))
        self._hashes = (langs.dictionary, both // max(len(words.distinct), 1), words.distinct, own)
        # A number that changes from piece to piece.
        self.piece = np.cumsum(_ENDS[raw], dtype=np.int64)[words.starts] + words.text

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct one's language and word."""
        langs, lang, distinct, own = self._hashes
        return hashes_of(langs)[lang], hashes_of(distinct)[own]

    def follows(self, by: int) -> np.ndarray:
        """Whether the word so many places on belongs to the same piece."""
        n = len(self.word)
        out = np.zeros(n, bool)
        if n > by:
            out[: n - by] = self.piece[by:] == self.piece[: n - by]
        return out


def _packed(values: np.ndarray, places: np.ndarray, width: str) -> pa.Array:
    """Consecutive numbers as one binary value for each range between ``places``."""
    raw = np.ascontiguousarray(values.astype(width))
    offsets = (places * raw.itemsize).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, buffers)


def _grams(span: _Span, at: np.ndarray, words: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The phrases of so many words at the places ``at``: the number of each among the
    distinct ones, and the language and text of those."""
    many = max(len(span.counts), 1)
    known, number = np.unique(span.word[at], return_inverse=True)
    lang, text = span.lang.take(pa.array(known)), span.text.take(pa.array(known))
    for k in range(1, words):
        known, number = np.unique(number * many + span.word[at + k], return_inverse=True)
        head, tail = pa.array(known // many), pa.array(known % many)
        text = pc.binary_join_element_wise(text.take(head), span.text.take(tail), " ")
        lang = lang.take(head)
    return number, lang, text


def _stripes_of(span: _Span, words: int, frequent: Bloom, hot: Bloom) -> pa.Table:
    """The stripes of the prefixes of so many words that are frequent. Words after them
    count only if they end a frequent phrase as long; else none follows."""
    n, w = len(span.word), span.word
    langs, texts = span.hashes()
    whole = np.flatnonzero(span.follows(words - 1))
    hashes = joined(langs[w[whole]], *[texts[w[whole + k]] for k in range(words)])
    known = frequent.has(hashes)
    at, hashes = whole[known], hashes[known]
    alive = np.zeros(n + 1, bool)
    alive[at] = True
    goes_on = span.follows(words)[at] & alive[at + 1]
    none = len(span.counts)
    following = np.full(len(at), none, np.int64)
    following[goes_on] = w[at[goes_on] + words]
    part = np.append((joined(texts) % np.uint64(SEGMENTS)).astype(np.int64), 0)
    segment = np.where(hot.has(hashes), part[following], 0)

    number, lang, text = _grams(span, at, words)
    line = np.sort((number * SEGMENTS + segment) * (none + 1) + following)
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])[: len(line)])
    counts = np.diff(np.append(first, len(line)))
    line = line[first]
    key = line // (none + 1)
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    places = np.append(begin, len(key))
    names = pa.concat_arrays([span.text, pa.array([_NONE])]).take(pa.array(line % (none + 1)))
    nexts = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), names)
    own = pa.array(key[begin] // SEGMENTS)
    return pa.table(
        [
            lang.take(own),
            text.take(own),
            pa.array((key[begin] % SEGMENTS).astype(np.int32)),
            pc.binary_join(nexts, " "),
            _packed(counts, places, "<u4"),
        ],
        schema=_STRIPE,
    )


def _over_spans(docs: DataFrame, text_col: str, lang_col: str, make, types: str) -> DataFrame:
    """Rows that ``make`` gives for the spans of a task."""

    def of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans() -> Iterator[_Span]:
            for batch in batches:
                for lo, hi, raw, offsets in text_spans(batch.column(0)):
                    yield _Span(raw, offsets, batch.column(1).slice(lo, hi - lo))

        for table in make(spans()):
            yield from table.combine_chunks().to_batches(max_chunksize=20_000)

    texts = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    return texts.mapInArrow(of_task, types)


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``word`` and its occurrences ``n``."""

    def counted(spans: Iterator[_Span]) -> Iterator[pa.Table]:
        return summed(
            (pa.table([s.lang, s.text, pa.array(s.counts)], ["lang", "word", "n"]) for s in spans),
            ["lang", "word"], "n",
        )

    parts = _over_spans(docs, text_col, lang_col, counted, "lang string, word string, n bigint")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _merge(table: pa.Table) -> pa.Table:
    """Stripes in order of their keys, those of one key made one: counters added.
    ``nexts`` are lists and ``counts`` lists of longs, in and out."""
    table = table.combine_chunks()
    changes = np.zeros(len(table), bool)
    changes[0] = True
    for name in ("lang", "prefix", "segment"):
        column = table[name].combine_chunks()
        changes[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(changes)
    key = np.cumsum(changes) - 1
    nexts = table["nexts"].combine_chunks()
    words = nexts.flatten().dictionary_encode()
    many = len(words.dictionary)
    line = np.repeat(key, np.diff(nexts.offsets.to_numpy())) * many + words.indices.to_numpy()
    order = np.argsort(line)
    line = line[order]
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
    counts = np.add.reduceat(table["counts"].combine_chunks().flatten().to_numpy()[order], first)
    line = line[first]
    places = pa.array(np.searchsorted(line // many, np.arange(len(begin) + 1)).astype(np.int32))
    kept = table.select(["lang", "prefix", "segment"]).take(pa.array(begin))
    followers = pa.ListArray.from_arrays(places, words.dictionary.take(pa.array(line % many)))
    added = pa.ListArray.from_arrays(places, pa.array(counts))
    return kept.append_column("nexts", followers).append_column("counts", added)


def _unpacked(batch: pa.RecordBatch) -> pa.Table:
    table = pa.Table.from_batches([batch]).select(["lang", "prefix", "segment"])
    nexts = pc.split_pattern(batch["nexts"].cast(pa.string()), " ")
    raw, _ = bytes_and_offsets(batch["counts"])
    counts = pa.array(np.frombuffer(raw.tobytes(), "<u4").astype(np.int64))
    offsets = pa.array((nexts.offsets.to_numpy() - nexts.offsets[0].as_py()).astype(np.int32))
    nexts = pa.ListArray.from_arrays(offsets, nexts.flatten())
    table = table.append_column("nexts", nexts)
    return table.append_column("counts", pa.ListArray.from_arrays(offsets, counts))


def _frequent_part(table: pa.Table, least: int) -> pa.RecordBatch:
    """Each stripe's sum, and of its elements those that are frequent words."""
    table = table.combine_chunks()
    nexts, counts = table["nexts"].combine_chunks(), table["counts"].combine_chunks()
    places, n = nexts.offsets.to_numpy(), counts.flatten().to_numpy()
    places = places - places[0]
    words = nexts.flatten()
    keep = (n >= least) & pc.not_equal(words, _NONE).to_numpy(zero_copy_only=False)
    kept = pa.array(np.append(0, np.cumsum(keep))[places].astype(np.int32))
    arrays = {
        "lang": table["lang"].combine_chunks(),
        "prefix": table["prefix"].combine_chunks(),
        "total": pa.array(np.add.reduceat(n, places[:-1])),
        "nexts": pa.ListArray.from_arrays(kept, words.filter(pa.array(keep))),
        "counts": pa.ListArray.from_arrays(kept, pa.array(n[keep])),
    }
    return pa.record_batch(arrays)


def merged_stripes(stripes: DataFrame, least: int = LEAST) -> DataFrame:
    """The stripes of equal ``lang``, ``prefix`` and segment added up: their ``total``
    and the elements of at least ``least``. Rows come sorted and are merged as they
    stream by; only the one stripe that is still growing is held."""

    def of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = _unpacked(batch)
            table = _merge(table if held is None else pa.concat_tables([held, table]))
            held = table.slice(len(table) - 1)
            if len(table) > 1:
                yield _frequent_part(table.slice(0, len(table) - 1), least)
        if held is not None:
            yield _frequent_part(held, least)

    key = ["lang", "prefix", "segment"]
    return stripes.repartition(*key).sortWithinPartitions(*key).mapInArrow(
        of_task,
        "lang string, prefix string, total bigint, nexts array<string>, counts array<bigint>",
    )


def _hashed(df: DataFrame, columns: list[str]) -> DataFrame:
    @F.arrow_udf("long")
    def of_batch(*parts: pa.Array) -> pa.Array:
        hashes = []
        for part in parts:
            encoded = part.dictionary_encode()
            hashes.append(hashes_of(encoded.dictionary)[encoded.indices.to_numpy()])
        return pa.array(joined(*hashes).view(np.int64))

    return df.select(of_batch(*columns).alias("h"))


def _extensions(stripes: DataFrame) -> DataFrame:
    """One row for each frequent phrase of two words or more: ``a`` occurrences."""
    pairs = F.explode(F.arrays_zip("nexts", "counts")).alias("e")
    found = stripes.select("lang", "prefix", pairs).select(
        "lang", "prefix", F.col("e.nexts").alias("next"),
        F.concat_ws(" ", "prefix", "e.nexts").alias("phrase"),
        F.col("e.counts").alias("a"),
    )
    return found.withColumn("words", F.size(F.split("phrase", " ")))


def phrase_stripes(
    docs: DataFrame, counts: DataFrame, least: int = LEAST,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Merged stripes of all prefixes of one to three frequent words. ``counts`` are
    :func:`word_counts` of the same documents."""
    share = docs.sparkSession.sparkContext.broadcast
    known, columns = counts.select("lang", "word", F.col("n").alias("a")), ["lang", "word"]
    whole = None
    for words in range(1, MOST_WORDS):
        grams = known.filter(F.col("a") >= least)
        frequent = share(bloom_of(_hashed(grams, columns), "h").words)
        hot = share(bloom_of(_hashed(grams.filter(F.col("a") >= HOT), columns), "h").words)

        def of_spans(spans: Iterator[_Span], words=words, frequent=frequent, hot=hot):
            for span in spans:
                yield _stripes_of(span, words, Bloom(frequent.value), Bloom(hot.value))

        made = _over_spans(docs, text_col, lang_col, of_spans, _STRIPE_TYPES)
        stripes = written(merged_stripes(made, least), f"stripes-{words}")
        whole = stripes if whole is None else whole.unionByName(stripes)
        known = _extensions(stripes).withColumn("w", F.split("phrase", " "))
        columns = ["lang", *[f"w{k}" for k in range(words + 1)]]
        known = known.select("lang", "a", *[F.col("w")[k].alias(f"w{k}") for k in range(words + 1)])
    return whole


def _words_from(phrase: Column, first: Column | int, many: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, many), " ")


def scored_phrases(stripes: DataFrame, least: int = LEAST) -> DataFrame:
    """Candidates with ``a``, ``l``, ``r`` and ``score`` of their lowest cut, without
    those that a longer phrase stands for. Counts are joined by phrase; a phrase has at
    most three cuts."""
    known = (
        stripes.groupBy("lang", "prefix").agg(F.sum("total").alias("f"))
        .filter(F.col("f") >= least)
    )
    phrases = _extensions(stripes)
    cuts = phrases.select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k",
        _words_from(F.col("phrase"), 1, F.col("k")).alias("head"),
        _words_from(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"),
    )
    left = known.select("lang", F.col("prefix").alias("head"), F.col("f").alias("l"))
    right = known.select("lang", F.col("prefix").alias("rest"), F.col("f").alias("r"))
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) DIV (l + r)").cast("long")
    lowest = (
        cuts.join(left, ["lang", "head"]).join(right, ["lang", "rest"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )
    # A longer phrase is no more frequent than those it holds, so the best of the
    # phrases longer by one word is the best of all.
    inner = F.array("prefix", _words_from(F.col("phrase"), 2, F.col("words") - 1))
    longer = (
        phrases.filter("words > 2")
        .select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("within"))
        .groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    )
    stands = F.expr("100 * CAST(within AS DECIMAL(20, 0)) >= 80 * CAST(a AS DECIMAL(20, 0))")
    return (
        lowest.join(longer, ["lang", "phrase"], "left")
        .filter(F.col("within").isNull() | ~stands)
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    most: int = PER_LANGUAGE,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The ``most`` best phrases of each language: ``lang``, ``rank``, ``phrase``,
    ``a``, ``l``, ``r``, ``n`` and ``score``.

    A null language is ``und``, a null text empty. Rows that repeat count again, ids
    play no part, other columns are not read. Equal scores go by ``a``, then by the
    phrase's bytes. Texts of any length are read whole, no phrase crosses from one text
    or piece into the next, and empty tables give no rows.
    """
    counts = written(word_counts(docs, text_col, lang_col), "collocation-words")
    scored = scored_phrases(phrase_stripes(docs, counts, least, text_col, lang_col), least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))
