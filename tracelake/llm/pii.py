"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) are found exactly by their patterns and
checks and always stay. Further kinds are kept when their score, a prior per
kind plus what the context adds or takes, reaches the threshold:

iban      country code, two check digits, 11 to 30 letters and digits; mod-97 must hold,
          at the country's length or else at the longest end of a group where it does
card_like 13 to 15 digits that pass Luhn (older and shorter card numbers)
ssn       ddd-dd-dddd outside the unissued ranges
secret    20 or more hexadecimal or base64 characters assigned to a name such as token or key
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "card_like", "ssn", "secret")
SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats and a look behind keep every pattern linear on long runs.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?i)\b(?:api[_-]?key|secret|token|passw(?:or)?d)\b[\"']?\s*+[:=]\s*+[\"']?([A-Za-z0-9+/_=-]{20,}+)")
_IBAN_LENGTHS = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for c in cs.split()
}
_NOT_DIGIT = re.compile(r"[^0-9]+")

PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "card_like": 0.4, "ssn": 0.4, "secret": 0.6}
FOR = {
    "email": "mail contact write courriel correo",
    "ip": "ip address host server login addr",
    "card": "card visa credit payment karte carte tarjeta",
    "phone": "phone call tel mobile fax telefon telephone",
    "iban": "iban bank account konto compte cuenta transfer",
    "card_like": "card visa credit amex payment karte carte tarjeta",
    "ssn": "ssn social security taxpayer",
    "secret": "token secret key password auth bearer",
}
AGAINST = frozenset("example sample test dummy version isbn order invoice serial part sku".split())
_FOR = {k: frozenset(v.split()) for k, v in FOR.items()}
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        at = i = m.start()
        while i > done and text[i - 1] in _LOCAL:
            i -= 1
        if i < at:
            done = m.end()
            yield i, done


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", *m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The pattern takes in what follows in capitals or digits, so every end of a group is tried: that of the country's length, then the longest."""
    at = 0
    while m := _IBAN.search(text, at):
        start, at = m.start(), m.start() + 1
        ends = [m.end(), *(e for e in range(m.end() - 1, start, -1) if text[e] == " ")]
        known = _IBAN_LENGTHS.get(m[0][:2])
        for e in sorted(ends, key=lambda e: len(text[start:e].replace(" ", "")) != known):
            if mod97(text[start:e]):
                yield start, e
                at = e
                break


def _more(text: str) -> Iterator[tuple[str, int, int]]:
    for s, e in _ibans(text):
        yield "iban", s, e
    for m in _CARD.finditer(text):
        if 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 15 and luhn(d):
            yield "card_like", *m.span()
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()
    for m in _SECRET.finditer(text):
        yield "secret", *m.span(1)


def _score(text: str, kind: str, start: int, end: int, reach: int) -> float:
    near = set(_WORD.findall(text[max(0, start - reach) : start].lower())) | set(_WORD.findall(text[end : end + reach].lower()))
    return round(min(1.0, max(0.0, PRIOR[kind] + 0.2 * bool(near & _FOR[kind]) - 0.3 * bool(near & AGAINST))), 3)


def find_spans(text: str | None, threshold: float = 0.5, reach: int = 40) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS, then start; code points, end exclusive. Added kinds never overlap a base span."""
    text = text or ""
    out = [(k, s, e, _score(text, k, s, e, reach)) for k, s, e in _base(text)]
    more = [(k, s, e) for k, s, e in _more(text)]
    taken = bytearray(len(text) if more else 0)
    for _, s, e, _ in out if more else ():
        taken[s:e] = b"\1" * (e - s)
    for k, s, e in more:
        if (score := _score(text, k, s, e, reach)) >= threshold and not any(taken[s:e]):
            taken[s:e] = b"\1" * (e - s)
            out.append((k, s, e, score))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def detect(docs: DataFrame, text_col: str = "text", out: str = "pii", threshold: float = 0.5) -> DataFrame:
    """Adds the array of spans found in each whole text, replacing a column of that name; null and empty texts have none.

    Rows, repeated or not, are judged one by one, whatever their ids. Empty
    input: empty result.
    """

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in find_spans(t, threshold)] for t in texts])

    return docs.withColumn(out, spans(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Replaces every span by ``<kind>``, overlapping spans by the placeholder of the first; null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = sorted(find_spans(t, threshold), key=lambda x: (x[1], -x[2]))
            if not found:
                out.append(t)
                continue
            parts, at = [], 0
            for kind, s, e, _ in found:
                if s >= at:
                    parts += [t[at:s], f"<{kind}>"]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))
