"""Opaque images inside a text: found, blanked for scoring, and left out of redaction."""

from __future__ import annotations

from spanguard.functions.offsets import candidates, marked_parts
from spanguard.functions.sqlx import each, each_indexed, empty, keep, let, lit, struct
from spanguard.schemas import RANGE

# base64 beginnings of PNG, JPEG and GIF data, and the shortest run that counts.
SIGNATURES = ("iVBORw0KGgo", "/9j/", "R0lGODdh", "R0lGODlh")
SHORTEST = 32
# First and last bytes of the decoded images.
PNG_HEAD, PNG_CHUNK, PNG_TAIL = "89504E470D0A1A0A", "49484452", "49454E44AE426082"
JPEG_HEAD, JPEG_TAIL = "FFD8FF", "FFD9"
GIF_HEADS, GIF_TAIL = ("474946383761", "474946383961"), "3B"

#: A base64 run that begins with a signature.
IMAGE_RUN = rf"(?<![A-Za-z0-9+/=])(?:{'|'.join(SIGNATURES)})[A-Za-z0-9+/=]*+"
#: Padded base64 whose unused bits are zero.
_CANONICAL = r"^[A-Za-z0-9+/]*+(?:(?<=[AQgw])==|(?<=[AEIMQUYcgkosw048])=)?\z"


def is_image(word: str) -> str:
    """A complete PNG, JPEG or GIF in standard base64."""

    def framed(data: str) -> str:
        head = f"hex(substring({data}, 1, 16))"

        def tail(n: int) -> str:
            return f"hex(substring({data}, octet_length({data}) - {n} + 1, {n}))"

        png = f"({head} like '{PNG_HEAD}________{PNG_CHUNK}' and {tail(8)} = '{PNG_TAIL}')"
        jpeg = f"({head} like '{JPEG_HEAD}%' and {tail(2)} = '{JPEG_TAIL}')"
        gif = f"(({head} like '{GIF_HEADS[0]}%' or {head} like '{GIF_HEADS[1]}%') and {tail(1)} = '{GIF_TAIL}')"
        return f"({png} or {jpeg} or {gif})"

    return (
        f"if(octet_length({word}) >= {SHORTEST} and octet_length({word}) % 4 = 0 and {word} rlike {lit(_CANONICAL)},"
        f" {let(f'unbase64({word})', framed)}, false)"
    )


def _may_hold_image(text: str) -> str:
    return "(" + " or ".join(f"contains({text}, {lit(s)})" for s in SIGNATURES) + ")"


def image_ranges(text: str) -> str:
    found = each(
        keep(candidates(text, IMAGE_RUN), lambda c: is_image(f"{c}.word")),
        lambda c: struct(start=f"{c}.start", end=f"{c}.end"),
    )
    return f"if({_may_hold_image(text)}, {found}, {empty(RANGE)})"


def scoring_text(text: str) -> str:
    """The text with every image replaced by as many blanks as it has bytes."""
    blanked = each_indexed(
        marked_parts(text, IMAGE_RUN),
        lambda p, i: f"if({i} % 2 = 1 and {is_image(p)}, repeat(' ', octet_length({p})), {p})",
    )
    return f"if({_may_hold_image(text)} and {text} rlike {lit(IMAGE_RUN)}, array_join({blanked}, ''), {text})"
