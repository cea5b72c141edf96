"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Kinds, in order: email, ip, card (Luhn), phone, and beyond these iban (mod 97). Within a kind matches are leftmost and do
not overlap; a match that its check rejects is dropped and nothing inside it is tried again. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
CONTEXT = 40  # code points on either side in which a kind's words raise the score
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9}
NEARBY = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "tél"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
}
AGAINST = {"ip": ("version", "release"), "card": ("order", "id", "serial"), "phone": ("id", "serial")}

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Inside a run of digits no later start can match where the first did not, so only the first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    code = iban.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so that a long run of letters costs no more than its length."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        if mod97(m[0]):
            yield m.span()


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans}


def _score(kind: str, text: str, start: int, end: int) -> float:
    around = text[max(0, start - CONTEXT) : start].lower() + " " + text[end : end + CONTEXT].lower()
    words = set(re.findall(r"\w+", around))
    score = BASE_SCORE[kind] + 0.2 * bool(words & set(NEARBY[kind])) - 0.2 * bool(words & set(AGAINST.get(kind, ())))
    return round(min(1.0, max(0.0, score)), 2)


def spans(text: str | None) -> list[Span]:
    """All confirmed spans, by kind as listed, then start."""
    text = text or ""
    return [Span(kind, a, b, _score(kind, text, a, b)) for kind in KINDS for a, b in FINDERS[kind](text)]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH):
            part = batch.slice(i, BATCH)
            found = [[s._asdict() for s in spans(t.as_py())] for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(_SPAN))], ["doc_id", "found"])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, found) of every row: found lists (kind, start, end, score).

    A null or empty text has no spans; null ids and repeated rows have a row each, an empty table none. Equal texts have
    equal spans, and other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_find, "doc_id long, found array<struct<kind:string,start:long,end:long,score:double>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans and the text of all spans."""
    said = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"), F.array_max(F.transform("found", lambda s: s["score"])).alias("top_score"))
