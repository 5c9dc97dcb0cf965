"""Personal data: patterns propose spans, checks confirm them, context scores them.

Patterns are searched from the one character each needs (``@``, ``+``, a digit), so
the cost is linear in a text even where it is one long run of a pattern's class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbside.llm.common import read_table

# Kinds in the order of the result. The first four are found by their
# pattern and check alone; the others also need a score of ADDED_SCORE.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "routing")
ADDED_SCORE = 0.5

# Score of a confirmed span without context, and the words around it that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "routing": 0.2}
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "handy", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "routing": ("routing", "aba", "transit"),
}
CONTEXT_BONUS = 0.4
CONTEXT_BEFORE, CONTEXT_AFTER = 48, 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMERIC = re.compile(r"[0-9][0-9. -]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_ROUTING = re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")

# Of two readings that pass the check the one of this length is the account.
_IBAN_LENGTHS = {
    entry[:2]: int(entry[2:])
    for entry in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 "
        "DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 "
        "IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 "
        "MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 "
        "TR26 UA29 VA22 VG24 XK20 "
    ).split()
}

Span = tuple[str, int, int]


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def mod97(account: str) -> bool:
    """Check of an IBAN without blanks: moved by four, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def routing_check(digits: list[int]) -> bool:
    return any(digits) and sum(d * w for d, w in zip(digits, (3, 7, 1) * 3, strict=True)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """From each @ back over the local part, not into the match before."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield "email", start, free
        at = text.find("@", max(at + 1, free))


def _phones(text: str) -> Iterator[Span]:
    plus = text.find("+")
    while plus >= 0:
        if (m := _PHONE.match(text, plus)) and 9 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()
        plus = text.find("+", plus + 1)


def _numbers(text: str) -> Iterator[Span]:
    for region in _NUMERIC.finditer(text):
        start, end = region.span()
        if end - start < 7:
            continue
        for m in _IP.finditer(text, start, end):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) < 4 and int(p or "0") <= 255 for p in parts):
                yield "ip", *m.span()
        for m in _CARD.finditer(text, start, end):
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
        for m in _ROUTING.finditer(text, start, end):
            if routing_check(_digits(m[0])):
                yield "routing", *m.span()


def _ibans(text: str) -> Iterator[Span]:
    """The pattern takes upper-case words behind an account for groups of it, so every
    end of a word in a match is tried: the one that gives the country's length first,
    then from the longest on."""
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        at = start + 4
        ends = [start + i for i, c in enumerate(m[0]) if c == " "]
        if not (text[end : end + 1].isascii() and text[end : end + 1].isalnum()):
            ends.append(end)
        accounts = {text[start:e].replace(" ", ""): e for e in reversed(ends)}
        usual = _IBAN_LENGTHS.get(text[start : start + 2])
        for account in sorted(accounts, key=lambda a: len(a) != usual):
            if 15 <= len(account) <= 34 and mod97(account):
                at = accounts[account]
                yield "iban", start, at
                break


def score(text: str, span: Span) -> float:
    kind, start, end = span
    around = text[max(0, start - CONTEXT_BEFORE) : start] + " " + text[end : end + CONTEXT_AFTER]
    words = re.findall(r"\w+", around.lower())
    near = any(word.startswith(CONTEXT[kind]) for word in words)
    return min(1.0, PRIOR[kind] + CONTEXT_BONUS * near)


def personal_spans(text: str) -> tuple[list[Span], list[float]]:
    """Spans by kind and start, with their scores."""
    found = [*_emails(text), *_phones(text), *_numbers(text), *_ibans(text)]
    kinds = BASE_KINDS + ADDED_KINDS
    found.sort(key=lambda s: (kinds.index(s[0]), s[1]))
    scored = [(s, score(text, s)) for s in found]
    kept = [(s, p) for s, p in scored if s[0] in BASE_KINDS or p >= ADDED_SCORE]
    return [s for s, _ in kept], [p for _, p in kept]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_COUNTS = ", ".join(f"n_{kind}: bigint" for kind in BASE_KINDS)
_FOUND = f"struct<{_COUNTS}, base: string, spans: string, scores: array<double>>"


def personal_data(text: Column) -> Column:
    """A struct of the counts, the joined base spans, all spans and their scores.

    Offsets are code points, the end exclusive. A null text is an empty one, and
    an empty one has no spans.
    """

    @F.arrow_udf(_FOUND)
    def of_batch(column: pa.Array) -> pa.Array:
        rows = []
        for value in column:
            spans, scores = personal_spans(value.as_py() or "")
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = {f"n_{k}": sum(s[0] == k for s in base) for k in BASE_KINDS}
            rows.append(counts | {"base": joined(base), "spans": joined(spans), "scores": scores})
        kind = pa.struct(
            [(f"n_{k}", pa.int64()) for k in BASE_KINDS]
            + [("base", pa.string()), ("spans", pa.string()), ("scores", pa.list_(pa.float64()))]
        )
        return pa.array(rows, kind)

    return of_batch.asNondeterministic()(text)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_table(spark, sf_dir, "documents").select(
        "doc_id", personal_data(F.col("text")).alias("found")
    )
    return found.select(
        "doc_id",
        *[f"found.n_{kind}" for kind in BASE_KINDS],
        F.sha2(F.col("found.base").cast("binary"), 256).alias("base_sha256"),
        "found.spans",
        "found.scores",
    )
