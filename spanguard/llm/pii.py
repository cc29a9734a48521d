"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanguard.llm.worker import kept

#: Kinds in the order of reports. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel")
SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"

# Length of an account number by country (ISO 13616, all countries of its registry).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
# Words that make a kind likelier.
CONTEXT = {
    "email": ("mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
    "tel": ("phone", "tel", "call", "mobile", "fax"),
}
PATTERN_SCORE, CHECK_SCORE, CONTEXT_SCORE, LEAST_SCORE = 0.4, 0.4, 0.3, 0.6
CONTEXT_WIDTH = 40


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _compiled() -> dict:
    """Each pattern takes time linear in the text: no start rescans what an earlier start has read."""
    return {
        "at": re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        "local": re.compile(r"[A-Za-z0-9._%+-]"),
        "ip": re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)"),
        "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
        "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])"),
        "account": {size: re.compile(rf"(?:\x20?[A-Z0-9]){{{size - 4}}}") for size in set(IBAN_LENGTH.values())},
        "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
        "tel": re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
        "digit": re.compile(r"[0-9]"),
        "context": {kind: re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, words)) + r")(?![^\W_])", re.IGNORECASE) for kind, words in CONTEXT.items()},
    }


def _emails(text: str, rx: dict):
    """The pattern ``local@label(.label)+`` from its sign outwards: the local part is the run before it, up to the last hit."""
    free = 0
    for hit in rx["at"].finditer(text):
        start = hit.start()
        while start > free and rx["local"].match(text, start - 1):
            start -= 1
        if start < hit.start():
            yield start, hit.end()
            free = hit.end()


def _accounts(text: str, rx: dict):
    """A span of its country's own length is tried at every start outside confirmed ones."""
    free = 0
    for hit in rx["iban"].finditer(text):
        size = IBAN_LENGTH.get(hit[0][:2]) if hit.start() >= free else None
        rest = rx["account"][size].match(text, hit.end()) if size else None
        if rest and not text[rest.end() : rest.end() + 1].isalnum() and mod97(text[hit.start() : rest.end()].replace(" ", "")):
            free = rest.end()
            yield hit.start(), free


def find(text: str | None) -> list[tuple[int, int, str, float]]:
    """Spans ``(start, end, kind, score)`` in code points by start, then kind. Null and empty texts have none."""
    if not text:
        return []
    rx = kept("pii", _compiled)
    found = []

    def put(kind: str, start: int, end: int, checked: bool, base: bool) -> None:
        around = text[max(0, start - CONTEXT_WIDTH) : start] + " " + text[end : end + CONTEXT_WIDTH]
        score = PATTERN_SCORE + CHECK_SCORE * checked + CONTEXT_SCORE * bool(rx["context"][kind].search(around))
        if base or score >= LEAST_SCORE:
            found.append((start, end, kind, round(min(1.0, score), 2)))

    if "@" in text:
        for start, end in _emails(text, rx):
            put("email", start, end, True, True)
    if rx["digit"].search(text):
        for hit in rx["ip"].finditer(text):
            if all(len(part) <= 3 and int(part) <= 255 for part in (x.lstrip("0") or "0" for x in hit.groups())):
                put("ip", *hit.span(), True, True)
        for hit in rx["card"].finditer(text):
            if 14 <= hit.end() - hit.start() <= 37 and 14 <= len(digits := hit[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                put("card", *hit.span(), True, True)
        for hit in rx["phone"].finditer(text) if "+" in text else ():
            if 10 <= sum(c in "0123456789" for c in hit[0]) <= 15:
                put("phone", *hit.span(), True, True)
        for start, end in _accounts(text, rx):
            put("iban", start, end, True, False)
        taken = sorted((s, e) for s, e, _, _ in found)
        reach = list(accumulate((e for _, e in taken), max))  # furthest end of the spans up to each
        for kind in ("ssn", "tel"):
            for hit in rx[kind].finditer(text):
                before = bisect_left(taken, (hit.end(),))  # spans that begin before the candidate ends
                if not before or reach[before - 1] <= hit.start():
                    put(kind, *hit.span(), False, False)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str | None, spans) -> str | None:
    """Each run of overlapping spans replaced by the kind of its first one in angle brackets; a null text stays null."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def spans_of(text: Column) -> Column:
    """All spans of a text; an empty array for null and empty texts."""

    @F.arrow_udf(SPAN)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": s, "end": e, "score": p} for s, e, k, p in find(t.as_py())] for t in texts], _TYPE)

    return spans(text)


def redacted(text: Column) -> Column:
    """The text with its spans replaced by their kinds; null stays null, empty stays empty, whole texts of any length."""

    @F.arrow_udf("string")
    def replaced(texts: pa.Array) -> pa.Array:
        return pa.array([redact(t, find(t)) for t in (x.as_py() for x in texts)], pa.string())

    return replaced(text)


def with_spans(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Adds the spans of each text. Repeated rows keep their own; other columns pass through."""
    return df.withColumn(spans, spans_of(F.col(text)))
