"""Deterministic recognizers: email, mobile, ID card, credit code, bank card, MAC and public IP address.

A recognizer turns a text into ``array<HIT>``.  All matches of its pattern are found left to right first, then each is
accepted or rejected by its neighbours and checksum, so a rejected match still uses up its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from spanguard.functions import checks
from spanguard.functions.frames import exploded
from spanguard.functions.offsets import candidates
from spanguard.functions.sqlx import each, empty, keep, lit, struct
from spanguard.operators.merge import arbitrated
from spanguard.schemas import CATEGORIES, HIT, KINDS

#: Score of a deterministic hit.
CERTAIN = 1.0

# What the patterns accept.
#   email        [A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}
#   mobile       1[3-9][0-9]{9}
#   ID card      [1-9][0-9]{5}(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]
#   credit code  [0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}
#   bank card    [0-9]{15,19}
#   MAC          [0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}
#   IP           four dotted groups of one to three digits, or one of three colon forms
MOBILE = r"1[3-9][0-9]{9}"
ID_CARD = r"[1-9][0-9]{5}(?:18|19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]"
CREDIT_CODE = r"[0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}"
BANK_CARD = r"[0-9]{15,19}"
MAC = r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}"
IP = (
    r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
    r"|(?:[0-9A-Fa-f]{1,4}:){2,7}(?::[0-9A-Fa-f]{1,4}){0,7}"
    r"|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){1,7}"
    r"|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}"
)

# Cheap patterns for what every match of a recognizer holds.  Each begins with one character class, which Java skips to
# quickly; what must follow is tested behind it.
IP_GUARD = r"[0-9:](?:(?<=[0-9])\.[0-9]{1,3}\.[0-9]|(?<=:)[0-9A-Fa-f]{0,4}:)"
MAC_GUARD = r"[:-][0-9A-Fa-f]{2}[:-]"
RUN_GUARD = r"[0-9]{6}"
#: Holds for every text in which any built-in recognizer finds something; most texts need only this one pass.
ANY_GUARD = (
    r"[@0-9:-](?:(?<=@)|(?<=[0-9])(?:[0-9]{5}|\.[0-9]{1,3}\.[0-9])"
    r"|(?<=[:-])[0-9A-Fa-f]{2}[:-]|(?<=:)[0-9A-Fa-f]{0,4}:)"
)

# The email pattern above, written so that Java needs linear time and no recursion: a local part is tried only where
# its run of characters begins (or right after the last match), every loop is possessive, and a label is taken whole
# only if a later label still begins with two letters.
_LABEL = r"[A-Za-z0-9\-]++"
_SKIPPED = rf"(?:\.(?![A-Za-z]{{2}}){_LABEL})*+"
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@"
    + _LABEL
    + rf"(?:{_SKIPPED}\.(?=[A-Za-z]{{2}}){_LABEL}(?={_SKIPPED}\.[A-Za-z]{{2}}))*+"
    + rf"{_SKIPPED}\.[A-Za-z]{{2,}}+"
)

# Mobile, ID card, credit code and bank card consist of ASCII letters and digits and must stand alone.  What they
# accept is therefore a whole run of such characters: a match cannot leave its run, one that covers the run starts at
# the run's first character, and any other match has a letter or digit beside it.  So one pass finds all four.
RUN = rf"(?<![0-9A-Za-z])(?:{MOBILE}|[0-9]{{17}}[Xx]|{BANK_CARD}|{CREDIT_CODE})(?![0-9A-Za-z])"


def hit(group: str, candidate: str, score: float = CERTAIN) -> str:
    return struct(
        entity_group=lit(group),
        score=lit(float(score)),
        start=f"{candidate}.start",
        end=f"{candidate}.end",
        word=f"{candidate}.word",
    )


def stands_alone(candidate: str) -> str:
    return f"not ({candidate}.before rlike '[0-9A-Za-z]' or {candidate}.after rlike '[0-9A-Za-z]')"


def stands_alone_dotted(candidate: str) -> str:
    return f"not ({candidate}.before rlike '[0-9.]' or {candidate}.after rlike '[0-9.]')"


def is_mobile(word: str) -> str:
    return f"{word} rlike {lit('^' + MOBILE + chr(92) + 'z')}"


def is_id_card(word: str) -> str:
    return f"({word} rlike {lit('^' + ID_CARD + chr(92) + 'z')} and {checks.id_card_ok(word)})"


def is_credit_code(word: str) -> str:
    return f"({word} rlike {lit('^' + CREDIT_CODE + chr(92) + 'z')} and {checks.credit_code_ok(word)})"


def is_bank_card(word: str) -> str:
    return f"({word} rlike {lit('^' + BANK_CARD + chr(92) + 'z')} and {checks.issuer_ok(word)} and {checks.luhn_ok(word)})"


def is_public_address(candidate: str) -> str:
    word = f"{candidate}.word"
    return (
        f"if(contains({word}, '.'), {stands_alone_dotted(candidate)} and {checks.ipv4_public(word)},"
        f" {stands_alone(candidate)} and {checks.ipv6_public(word)})"
    )


_RUN_GROUPS = {
    "private_phone": is_mobile,
    "id_card": is_id_card,
    "credit_code": is_credit_code,
    "bank_card": is_bank_card,
}


def email_hits(text: str) -> str:
    found = each(candidates(text, EMAIL), lambda c: hit("private_email", c))
    # The byte search decides for most texts before the pattern runs.
    return f"if(contains({text}, '@'), {found}, {empty(HIT)})"


def run_hits(text: str, groups: Iterable[str] = tuple(_RUN_GROUPS)) -> str:
    def accepted(c: str) -> str:
        tests = ", ".join(f"if({_RUN_GROUPS[g](f'{c}.word')}, {hit(g, c)}, null)" for g in groups)
        return f"array_compact(array({tests}))"

    return f"flatten({each(candidates(text, RUN, RUN_GUARD), accepted)})"


def mac_hits(text: str) -> str:
    return each(keep(candidates(text, MAC, MAC_GUARD, beside=True), stands_alone), lambda c: hit("mac_address", c))


def ip_hits(text: str) -> str:
    return each(keep(candidates(text, IP, IP_GUARD, beside=True), is_public_address), lambda c: hit("ip_address", c))


def builtin_hits(text: str) -> str:
    """All built-in recognizers, before arbitration."""
    found = f"concat({email_hits(text)}, {run_hits(text)}, {mac_hits(text)}, {ip_hits(text)})"
    return f"if({text} rlike {lit(ANY_GUARD)}, {found}, {empty(HIT)})"


@dataclass(frozen=True)
class Recognizer:
    """A further recognizer for the same merge: ``hits`` maps the text column to a column of ``array<HIT>``.

    Hits of one recognizer are sorted and disjoint.  ``kind`` says what they mean: an ``authoritative`` category is
    closed to scorers, an ``additive`` one only where the two overlap.
    """

    name: str
    group: str
    kind: str
    hits: Callable[[Column], Column]


class Recognizers:
    """The built-in recognizers and whatever was added; also the only answer to how a category is recognized."""

    def __init__(self, extra: Iterable[Recognizer] = ()):
        self.extra: list[Recognizer] = []
        for recognizer in extra:
            self.register(recognizer)

    def register(self, recognizer: Recognizer) -> None:
        if recognizer.kind not in KINDS:
            raise ValueError(f"unknown kind {recognizer.kind!r}")
        if recognizer.group not in {name for name, _, _ in CATEGORIES}:
            raise ValueError(f"unknown category {recognizer.group!r}")
        self.extra.append(recognizer)

    def kind_of(self, group: str) -> str | None:
        """Kind of the first recognizer of this category; None if only scorers find it."""
        builtin = {name: kind for name, _, kind in CATEGORIES}.get(group)
        if builtin is not None:
            return builtin
        return next((r.kind for r in self.extra if r.group == group), None)

    def authoritative(self) -> list[str]:
        return [name for name, _, _ in CATEGORIES if self.kind_of(name) == "authoritative"]

    def with_hits(self, df: DataFrame, text: str, output: str) -> DataFrame:
        """Add the arbitrated deterministic hits of column ``text``."""
        found = f"`{output}__found`"
        parts = [F.expr(builtin_hits(f"`{text}`"))]
        parts += [r.hits(F.col(text)).cast(f"array<{HIT}>") for r in self.extra if r.kind != "probabilistic"]
        joined = parts[0] if len(parts) == 1 else F.concat(*parts)
        return (
            df.withColumn(f"{output}__found", joined)
            .withColumn(output, F.expr(arbitrated(found)))
            .drop(f"{output}__found")
        )


def detect(df: DataFrame, text: str = "text", recognizers: Recognizers | None = None) -> DataFrame:
    """Scan a corpus: one row per accepted hit, with the columns of ``df`` other than the text."""
    found = (recognizers or Recognizers()).with_hits(df, text, "hits")
    kept = [c for c in df.columns if c != text]
    return exploded(found, kept, "hits", "hit").select(*kept, "hit.*")


def recognized(df: DataFrame, text: str, hits: str) -> DataFrame:
    """One row per hit of a single recognizer given as SQL text (see ``email_hits`` and its siblings)."""
    kept = [c for c in df.columns if c != text]
    return exploded(df, kept, F.expr(hits), "hit").select(*kept, "hit.*")
