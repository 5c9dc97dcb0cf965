"""Secrets: fixed patterns, and tokens that pass a battery of randomness tests.

A long token without prose characters is tried against the alphabet of its inferred
encoding: by uniformity (chi-squared), runs above and below the middle of the alphabet
and serial correlation; by how much likelier its letters, cases and separators are as
words and numbers than as random characters; and by how much likelier what it decodes
to is as text than as random bytes. Each is a rank among random tokens of the same
encoding and length, and so is the smallest of them: even for random tokens, near zero
for structured ones. For each class of lengths these ranks of the whole corpus tell
which part above a cutoff is still structured, and the lowest cutoff that holds this
false-discovery rate is used. No cutoff exceeds a tenth of the ranks, so no class loses
more than that part of its random tokens: where structured ones are spread over all
ranks, no cutoff tells them apart, and they are reported too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import read_table

# Kinds in the order of the result, and least lengths. Of an
# assignment the length is the value's.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KIND = "random"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

LEAST_TOKEN = 20
FALSE_DISCOVERIES = 0.05
# Lower ends of the length classes, and how finely p-values are counted.
LENGTH_CLASSES = (20, 24, 32, 40, 64, 128)
P_BINS = 20
# Cutoffs end at this bin.
LAST_CUT = 2
# The rank among NULL_DRAWS random tokens below which a token is structured without
# regard to the corpus.
LEAST_P = 0.005
NULL_DRAWS = 400
# Lengths above share the null of this one; their bits are scaled to it.
NULL_LENGTH = 256
# How unlikely the ranks of a class must be for random tokens alone to be cut.
EVIDENCE = 0.01

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _either_case(name: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)


_ASSIGN = re.compile(
    f"(?:{'|'.join(map(_either_case, _NAMES))})"
    r"""["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}+")
# Without "=": it stands before a token or pads its end.
_TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_TOKEN},}}+")
# Where a token without an encoding is cut, coarse to fine.
_CUTS = [re.compile(p) for p in (r"[^/]++", r"[^_-]++", r"[^+/_-]++")]

# Alphabets from the narrowest to the widest; a token has the first that holds it.
_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_PLACES = {name: {c: i for i, c in enumerate(chars)} for name, chars in ENCODINGS.items()}

# Bits that a letter or the end of a word (the first row and column) costs after
# another: identifiers of the Python library and prose in four languages.
_LETTER_BITS = """
a35443566487554457443666888 37645686849744376944347887a 449672a9954a29947a6684aaa49
44a7949a23a447938a673699a9a 2479628a739a69649a6565a898a 2485466885a9463768344778688
1598755993aa69838a4665aaa8a 247892a754a958558a546588aa8 2368a2a854a869648a655787aa8
4675644698a9552369633a697a7 22a6a2aaa7a7aaa47a9794aaa9a 26a8719794aa596779748695a9a
34886239a3a949847a855599a4a 3359729aa4a976833a9576aaa8a 2475337465a7686479753677a89
47655848a6a765275a3553769a9 3397735a85a949835a364599a5a 4aaa9aaaa9aa9a889a78a0aaaaa
2477728574a776448a555687a69 2685829744987885697535a8a7a 2487838923a978748a456598a67
3666836785a94536583448894a9 42a9a19993aaa7859a99aaa9aaa 3399749a13aa79549a469aa89aa
1483948a95aa67a647672a7a789 1678849965aa76553a744996a99 256682a7748766868876627aa97
"""
_SYMBOLS = _LOWER + _UPPER + _DIGITS + "+/-_"
_SYMBOL = {c: i for i, c in enumerate(_SYMBOLS)}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by start, then kind."""
    found = [
        ("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE
    ]
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST_ACCESS:
            found.append(("access", *m.span()))
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def encoding_of(token: str) -> str | None:
    """The narrowest encoding whose alphabet holds the token. Words and numbers,
    that is letters or digits alone, are none."""
    if token.isdigit() or token.isalpha() and (token.islower() or token.isupper()):
        return None
    used = set(token)
    return next((n for n, places in _PLACES.items() if used <= places.keys()), None)


def _word_bits() -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the first symbol and of each after another, in words,
    camel case, numbers and separators."""
    letters = np.exp2([[-int(c, 16) for c in row] for row in _LETTER_BITS.split()])
    letters /= letters.sum(axis=1, keepdims=True)
    opening = letters[0, 1:] / letters[0, 1:].sum()
    digits, marks = np.full(10, 1 / 10), np.full(4, 1 / 4)

    def after(letter: float, digit: float, mark: float) -> np.ndarray:
        return np.concatenate(
            [letter / 2 * opening, letter / 2 * opening, digit * digits, mark * marks]
        )

    lower, upper = [], []
    for row in letters[1:]:
        end, inner = row[0], row[1:]
        other = [end / 2 * digits, end / 2 * marks]
        lower.append(np.concatenate([0.9 * inner, 0.1 * (1 - end) * opening, *other]))
        upper.append(np.concatenate([0.5 * inner, 0.5 * inner, *other]))
    rest = [after(0.15, 0.7, 0.15)] * 10 + [after(0.6, 0.35, 0.05)] * 4
    return np.log2(after(0.75, 0.2, 0.05)), np.log2(np.array([*lower, *upper, *rest]))


_FIRST, _NEXT = _word_bits()


def word_bits(token: str, encoding: str) -> float:
    """By how many bits the token is likelier as words than as random characters."""
    at = np.array([_SYMBOL[c] for c in token])
    words = _FIRST[at[0]] + _NEXT[at[:-1], at[1:]].sum()
    return float(words + len(token) * math.log2(len(ENCODINGS[encoding])))


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def p_random(token: str, encoding: str) -> float:
    """How often a random token would look as structured: the smallest of three
    p-values, corrected for their number."""
    places = _PLACES[encoding]
    size = len(places)
    values = np.array([places[c] for c in token], float)
    n = len(values)
    # Uniformity; chi-squared to a normal deviate by Wilson and Hilferty's cube root.
    counts = np.bincount(values.astype(int), minlength=size)
    chi = ((counts - n / size) ** 2).sum() * size / n
    spread = 2 / (9 * (size - 1))
    tails = [_normal_tail(((chi / (size - 1)) ** (1 / 3) - 1 + spread) / math.sqrt(spread))]
    # Runs of the upper and of the lower half of the alphabet.
    upper = values >= size / 2
    a = int(upper.sum())
    b = n - a
    if a and b:
        expected = 1 + 2 * a * b / n
        variance = (expected - 1) * (expected - 2) / (n - 1)
        runs = 1 + int((upper[1:] != upper[:-1]).sum())
        z = abs(runs - expected) / math.sqrt(variance) if variance > 0 else 0.0
        tails.append(2 * _normal_tail(z))
    else:
        tails.append(2.0 ** (1 - n))
    # Correlation of each character with the next.
    x, y = values[:-1] - values[:-1].mean(), values[1:] - values[1:].mean()
    scale = math.sqrt((x * x).sum() * (y * y).sum())
    r = (x * y).sum() / scale if scale else 1.0
    tails.append(2 * _normal_tail(abs(r) * math.sqrt(n - 1)))
    return 1 - (1 - min(1.0, *tails)) ** len(tails)


# Bits for a byte as text over a random one: 0.9 of text is printable ASCII or blanks.
_IS_TEXT = np.isin(np.arange(256), [9, 10, 13, *range(32, 127)])
_TEXT_BITS = np.where(
    _IS_TEXT, np.log2(0.9 * 256 / _IS_TEXT.sum()), np.log2(0.1 * 256 / (~_IS_TEXT).sum())
)
_BASE64 = _UPPER + _LOWER + _DIGITS
_SIXES = {c: i for i, c in enumerate(_BASE64)} | {"+": 62, "-": 62, "/": 63, "_": 63}
# Bits a character stands for and its value, where that is not base64.
_DECODED = {
    "hex": (4, _PLACES["hex"]), "HEX": (4, _PLACES["HEX"]), "base32": (5, _PLACES["base32"])
}


def text_bits(token: str, encoding: str) -> float:
    """By how many bits the decoded token is likelier as text than as random bytes, at
    the best of the offsets at which a byte can begin."""
    size, values = _DECODED.get(encoding, (6, _SIXES))
    at = np.array([values[c] for c in token])
    bits = ((at[:, None] >> np.arange(size - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    best = -math.inf
    for first in sorted({-size * i % 8 for i in range(8)}):
        whole = (len(bits) - first) // 8
        found = np.packbits(bits[first : first + 8 * whole])
        best = max(best, float(_TEXT_BITS[found].sum()))
    return best


def _statistics(token: str, encoding: str) -> tuple[float, float, float]:
    """Three numbers, each the smaller the more structured the token is."""
    scale = min(1.0, NULL_LENGTH / len(token))
    words, text = word_bits(token, encoding), text_bits(token, encoding)
    return p_random(token, encoding), -words * scale, -text * scale


def _rank(value: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Ranks between 0 and 1 among the sorted null, equal values in their middle."""
    below = np.searchsorted(null, value, "left") + np.searchsorted(null, value, "right")
    return (below / 2 + 0.5) / (len(null) + 1)


@lru_cache(maxsize=None)
def _null(encoding: str, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The statistics of random tokens and the smallest of their ranks, in order."""
    chars = np.array(list(ENCODINGS[encoding]))
    drawn = np.random.default_rng(length).integers(0, len(chars), (NULL_DRAWS, length))
    each = np.array([_statistics("".join(row), encoding) for row in chars[drawn]]).T
    nulls = [np.sort(values) for values in each]
    least = np.min([_rank(values, null) for values, null in zip(each, nulls)], axis=0)
    return nulls, np.sort(least)


def rank_random(token: str, encoding: str) -> float:
    """The rank of the token's most structured statistic among random tokens of the
    encoding and length; 0 where no random one looks as structured."""
    nulls, least = _null(encoding, min(len(token), NULL_LENGTH))
    found = _statistics(token, encoding)
    at = float(_rank(min(_rank(v, null) for v, null in zip(found, nulls)), least))
    return at if at >= LEAST_P else 0.0


def length_class(length: int) -> int:
    return max(c for c in LENGTH_CLASSES if c <= length)


def _tokens(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Start and end of the long tokens, less what base spans hold of them."""
    held: list[list[int]] = []
    for _, start, end in base:
        if held and start <= held[-1][1]:
            held[-1][1] = max(held[-1][1], end)
        else:
            held.append([start, end])
    i = 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while i < len(held) and held[i][1] <= start:
            i += 1
        while i < len(held) and held[i][0] < end:
            if held[i][0] - start >= LEAST_TOKEN:
                yield start, held[i][0]
            start = held[i][1]
            if start >= end:
                break
            i += 1
        if end - start >= LEAST_TOKEN:
            yield start, end


def _parts(token: str) -> Iterator[tuple[int, int, float]]:
    """Start, end and rank of the token or, where it has no encoding or is structured,
    of its long parts between slashes, dashes and underscores that are not and that no
    coarser part holds."""
    if (encoding := encoding_of(token)) and (p := rank_random(token, encoding)):
        yield 0, len(token), p
        return
    taken = bytearray(len(token))
    for cut in _CUTS:
        for m in cut.finditer(token):
            start, end = m.span()
            length = end - start
            if not LEAST_TOKEN <= length < len(token) or taken.count(1, start, end) == length:
                continue
            if (encoding := encoding_of(m[0])) and (p := rank_random(m[0], encoding)):
                taken[start:end] = b"\1" * length
                yield start, end, p


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, int, float]]:
    """Start, end, length class and rank of each token outside the base spans that is
    not structured by itself."""
    for at, stop in _tokens(text, base):
        for start, end, p in _parts(text[at:stop]):
            yield at + start, at + end, length_class(end - start), p


def _bin(p: float) -> int:
    return min(P_BINS - 1, int(p * P_BINS))


def p_value_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``length_class``, ``bin``, ``n``: the p-values of all tokens of all texts,
    counted. Not more rows than classes times bins."""

    @F.arrow_udf("array<struct<length_class: int, bin: int>>")
    def of_batch(column: pa.Array) -> pa.Array:
        rows = []
        for value in column:
            text = value.as_py() or ""
            found = candidates(text, base_spans(text))
            rows.append([{"length_class": c, "bin": _bin(p)} for _, _, c, p in found])
        kind = pa.struct([("length_class", pa.int32()), ("bin", pa.int32())])
        return pa.array(rows, pa.list_(kind))

    each = docs.select(F.explode(of_batch.asNondeterministic()(F.col(text_col))).alias("c"))
    return each.groupBy("c.length_class", "c.bin").agg(F.count(F.lit(1)).alias("n"))


def cutoffs(counts: dict[tuple[int, int], int], rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For each length class the lowest bin from which on all are reported.

    The upper half of the p-values is taken to be of random tokens, so their
    number is twice that half's, and the part of it in any bin is the same. Where the
    lower half is no larger than chance makes it, or nothing is structured, all are
    reported. Where no cutoff up to ``LAST_CUT`` holds the rate, that one is used.
    """
    lowest = {}
    for of in {c for c, _ in counts}:
        n = [counts.get((of, b), 0) for b in range(P_BINS)]
        upper = sum(n[P_BINS // 2 :])
        # Of as many random tokens, how often so few lie in the upper half.
        spread = math.sqrt(sum(n)) / 2
        if _normal_tail((sum(n) / 2 - upper - 0.5) / spread) > EVIDENCE:
            lowest[of] = 0
            continue
        random = min(sum(n), 2 * upper)
        lowest[of] = LAST_CUT
        for b in range(LAST_CUT):
            above = sum(n[b:])
            if above - random * (1 - b / P_BINS) <= rate * above:
                lowest[of] = b
                break
    return lowest


def learned_cutoffs(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    rows = p_value_counts(docs, text_col).collect()
    return cutoffs({(r.length_class, r.bin): r.n for r in rows})


def secret_spans(text: str, lowest: dict[int, int]) -> list[Span]:
    """Base spans and reported random tokens, by start, then kind."""
    base = base_spans(text)
    added = [
        (ADDED_KIND, start, end)
        for start, end, of, p in candidates(text, base)
        if of in lowest and _bin(p) >= lowest[of]
    ]
    kinds = (*BASE_KINDS, ADDED_KIND)
    return sorted([*base, *added], key=lambda s: (s[1], kinds.index(s[0])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_COUNTS = ", ".join(f"n_{kind}: bigint" for kind in BASE_KINDS)


def secrets_in(text: Column, lowest: dict[int, int]) -> Column:
    """A struct of the counts, the joined base spans and all spans of a text.

    Offsets are code points, the end exclusive. A null text is an empty one, and
    an empty one has no spans.
    """

    @F.arrow_udf(f"struct<{_COUNTS}, base: string, spans: string>")
    def of_batch(column: pa.Array) -> pa.Array:
        rows = []
        for value in column:
            spans = secret_spans(value.as_py() or "", lowest)
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = {f"n_{k}": sum(s[0] == k for s in base) for k in BASE_KINDS}
            rows.append(counts | {"base": _joined(base), "spans": _joined(spans)})
        kind = [(f"n_{k}", pa.int64()) for k in BASE_KINDS]
        return pa.array(rows, pa.struct([*kind, ("base", pa.string()), ("spans", pa.string())]))

    return of_batch.asNondeterministic()(text)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by its kinds."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        kinds = [kind]
        while i + 1 < len(spans) and spans[i + 1][1] < end:
            i += 1
            end = max(end, spans[i][2])
            kinds.append(spans[i][0])
        out += [text[at:start], "[", "+".join(dict.fromkeys(kinds)).upper(), "]"]
        at = end
        i += 1
    return "".join([*out, text[at:]])


def without_secrets(text: Column, lowest: dict[int, int]) -> Column:
    """The text with its secrets redacted; null stays null."""

    @F.arrow_udf("string")
    def of_batch(column: pa.Array) -> pa.Array:
        texts = [value.as_py() for value in column]
        return pa.array(
            [None if t is None else redacted(t, secret_spans(t, lowest)) for t in texts],
            pa.string(),
        )

    return of_batch.asNondeterministic()(text)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = docs.select(
        "doc_id", secrets_in(F.col("text"), learned_cutoffs(docs)).alias("found")
    )
    return found.select(
        "doc_id",
        *[f"found.n_{kind}" for kind in BASE_KINDS],
        F.sha2(F.col("found.base").cast("binary"), 256).alias("base_sha256"),
        "found.spans",
    )
