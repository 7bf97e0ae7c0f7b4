"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are settled by their patterns and validators and
stay whatever the score.  The method adds kinds that need more evidence: ``iban``
(mod-97) and ``id`` (a nine-digit number in groups of 3-2-4, only where a context word
stands near).  A span is reported with its score: the kind's own, more for a passed
checksum, more for a context word within ``CONTEXT_CHARS`` before it.

Scans are linear in the text: each pattern starts only where a run of its characters
starts, and no run is read again.

Defined results: a null text is the empty text and has no spans; offsets are code
points, the end is exclusive; repeated rows are judged each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "id")
KINDS = BASE_KINDS + ADDED_KINDS
CONTEXT_CHARS = 48
#: A span of an added kind counts from this score on.
LEAST_SCORE = 0.8
OWN_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.5, "iban": 0.5, "id": 0.4}
CHECKED = {"card", "iban", "ip"}
CONTEXT = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "credit", "visa", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "llame"),
    "iban": ("iban", "bank", "konto", "account", "cuenta", "compte"),
    "id": ("ssn", "social", "security", "identity", "passport", "ausweis"),
}

_DIGIT = re.compile("[0-9]")
_AT_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_IBAN_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
#: Characters of an IBAN by country; another country's may end at any space.
IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB PL",
        29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for country in countries.split()
}
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost match ends in the run of local characters before an @, so only those runs are read."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _AT_DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in match.group().split(".")):
            yield match.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = match.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield match.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in match.group()) <= 15:
                yield match.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The country gives the length, else the longest reading that passes counts; what follows a failed one is read anew."""
    match = _IBAN.search(text)
    while match:
        start, at = match.start(), match.start() + 1
        length = IBAN_LENGTH.get(text[start : start + 2])
        for end in reversed([m.end() for m in _IBAN_END.finditer(text, start + 4, match.end())]):
            found = text[start:end].replace(" ", "")
            if not 15 <= len(found) <= 34 or text[end : end + 1].isalnum() and text[end : end + 1].isascii():
                continue
            if length in (None, len(found)) and mod97(found):
                yield start, end
                at = end
                break
        match = _IBAN.search(text, at)


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    for match in _ID.finditer(text):
        yield match.span()


_PROPOSE = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "id": _numbers}


def find_spans(text: str | None) -> list[Span]:
    """All spans of ``text``, by kind as listed in KINDS, then by start."""
    text, out = text or "", []
    for kind in KINDS if _DIGIT.search(text) else ("email",):
        for start, end in _PROPOSE[kind](text):
            near = text[max(0, start - CONTEXT_CHARS) : start].lower()
            score = min(1.0, OWN_SCORE[kind] + 0.3 * (kind in CHECKED) + 0.4 * any(re.search(rf"\b{word}", near) for word in CONTEXT[kind]))
            if kind in BASE_KINDS or score >= LEAST_SCORE:
                out.append(Span(kind, start, end, score))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the four base counts, base_sha256, spans, scores; one pass without a shuffle."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t) for t in batch.column(1).to_pylist()]
            base = [[s for s in spans if s.kind in BASE_KINDS] for spans in found]
            columns = [batch.column(0)]
            columns += [pa.array([sum(s.kind == kind for s in spans) for spans in base], pa.int64()) for kind in BASE_KINDS]
            columns.append(pa.array([hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base], pa.string()))
            columns.append(pa.array([joined(spans) for spans in found], pa.string()))
            columns.append(pa.array([[s.score for s in spans] for spans in found], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redact(text: str | None) -> str | None:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first, then the longest."""
    if not text:
        return text
    out, done = [], 0
    for span in sorted(find_spans(text), key=lambda s: (s.start, -s.end)):
        if span.start >= done:
            out += [text[done : span.start], f"[{span.kind.upper()}]"]
            done = span.end
        elif span.end > done:
            done = span.end
    return "".join(out) + text[done:] if out else text


def redact_column(text):
    """The column ``text`` redacted, batch by batch."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(texts):
        return texts.map(redact, na_action="ignore")

    return run(text)
