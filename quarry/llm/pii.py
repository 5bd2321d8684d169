"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds of the base set: ``email``, ``ip``, ``card`` (Luhn) and ``phone``; added by the method, if their score
reaches ``LEAST``: ``iban`` and ``nir`` (mod 97) and ``dni`` (a letter mod 23). An IBAN is found unless words near
it speak against it; numbers of the other two kinds come up by chance, so that words near them must speak for them.
Every text is searched whole.

Defined results: a null text counts as empty and has no spans; an empty text has none; repeated rows each
get their own result; extra columns of the input are ignored (``find``) or kept as they are (``redact``).
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_columns

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "nir", "dni")
KINDS = (*BASE_KINDS, *ADDED_KINDS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of dotted numbers; an address is any four consecutive parts of it, taken from the left.
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){3,}+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")

NIR = re.compile(r"(?<![A-Za-z0-9])[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![A-Za-z0-9])")
DNI = re.compile(r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Z](?![A-Za-z0-9])")
#: The letter of a number mod 23, in order.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

#: Score of a confirmed span without context, by kind, and what context words add.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "nir": 0.5, "dni": 0.5}
RAISED_BY = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("address", "server", "host", "login"),
    "card": ("card", "visa", "credit", "payment", "tarjeta", "karte", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "nir": ("nir", "insee", "sécurité sociale", "assuré"),
    "dni": ("dni", "nif", "identidad", "documento"),
}
LOWERED_BY = {
    "email": ("example",),
    "ip": ("version", "release", "build"),
    "card": ("order", "invoice", "serial", "isbn", "tracking"),
    "phone": ("version", "serial"),
    "iban": ("serial", "model"),
    "nir": ("serial", "tracking"),
    "dni": ("serial", "tracking"),
}
NEAR = 40
RAISE, LOWER = 0.2, 0.3
#: The score that a span of an added kind needs.
LEAST = 0.6


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def mod97(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """Leftmost matches, found from each @ outwards, so that long runs cost no more than their length."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, start)
            at = text.find("@", at + 1)


def addresses(text: str):
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def cards(text: str):
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def ibans(text: str):
    for m in IBAN.finditer(text):
        groups = m[0].split(" ")
        for n in range(len(groups), 0, -1):  # a word in capitals may follow
            if 15 <= len(joined := "".join(groups[:n])) <= 34 and mod97(joined):
                yield m.start(), m.start() + len(" ".join(groups[:n]))
                break


def nirs(text: str):
    for m in NIR.finditer(text):
        digits = m[0].replace(" ", "")
        if int(digits[:13]) % 97 + int(digits[13:]) == 97:
            yield m.span()


def dnis(text: str):
    for m in DNI.finditer(text):
        if DNI_LETTERS[int(m[0][:8]) % 23] == m[0][-1]:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, addresses, cards, phones, ibans, nirs, dnis), strict=True))


def score(text: str, start: int, end: int, kind: str) -> float:
    near = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
    s = PRIOR[kind] + RAISE * any(w in near for w in RAISED_BY[kind]) - LOWER * any(w in near for w in LOWERED_BY[kind])
    return round(min(1.0, max(0.0, s)), 3)


def spans(text: str | None, least: float = LEAST) -> list[Span]:
    """Spans of the whole text by start, then kind as listed. ``least`` holds for added kinds only: base spans stay."""
    found = []
    for rank, kind in enumerate(KINDS):
        for start, end in FINDERS[kind](text or ""):
            s = score(text, start, end, kind)
            if kind in BASE_KINDS or s >= least:
                found.append((start, rank, Span(start, end, kind, s)))
    return [s for _, _, s in sorted(found)]


def redacted(text: str | None) -> str | None:
    """The text with each span (overlapping ones as one, named by the first) replaced by its kind."""
    if text is None:
        return None
    out, at = [], 0
    for s in spans(text):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


SPAN_DDL = "id long, spans array<struct<start:long,end:long,kind:string,score:double>>"


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, spans): every span of every whole text, code-point offsets, end exclusive."""

    def make():
        return lambda ids, texts: [ids, [[{"start": s.start, "end": s.end, "kind": s.kind, "score": s.score} for s in spans(t, least)] for t in texts]]

    return map_columns(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, SPAN_DDL)


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The input's rows and columns with redacted texts (null stays null); ``chars_col`` is brought up to date."""

    @F.pandas_udf("string")
    def cover(texts):
        import pandas as pd

        return pd.Series([redacted(t) for t in texts], dtype=object)

    out = df.withColumn(text_col, cover(text_col))
    return out.withColumn(chars_col, F.length(text_col).cast("long")) if chars_col in df.columns else out


def digest(df: DataFrame) -> DataFrame:
    """The digest columns of the documents' spans, from ``find``."""

    def of(kinds: tuple[str, ...]):
        kept = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(df).select(
        F.col("id").alias("doc_id"), *(count(k) for k in BASE_KINDS),
        F.sha2(of(BASE_KINDS), 256).alias("base_sha256"), of(KINDS).alias("spans"), *(count(k) for k in ADDED_KINDS),
        F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 3)), ",").alias("scores"),
    )
