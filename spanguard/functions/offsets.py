"""Byte offsets, slices and literal or pattern occurrences, as SQL expression text.

Offsets are UTF-8 bytes.  ``raw`` is the text cast to binary: slicing it by byte position costs the slice, not the
text before it.
"""

from __future__ import annotations

from spanguard.functions.sqlx import each, each_indexed, empty, fresh, keep, let, lit, prefix_sums, struct
from spanguard.schemas import RANGE

CANDIDATE = "struct<start:int,end:int,word:string>"
NEIGHBOURED = "struct<start:int,end:int,word:string,before:string,after:string>"

#: Separator put around matches.  A text that holds it gets a blank there instead: one byte for one byte, and a
#: character that no recognizer accepts, so offsets and matches stay what they were.
MARK = "\x01"

# Code points with the Unicode property White_Space.
WHITE_SPACE = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Characters that continue a cut token; the second set only for credential categories.
TOKEN_CLASS = r"A-Za-z0-9_\-.@%+~"
CREDENTIAL_CLASS = TOKEN_CLASS + r"/:=?&#!$\^*|"


def cut(raw: str, start: str, end: str) -> str:
    return f"cast(substring({raw}, {start} + 1, {end} - {start}) as string)"


def marked_parts(text: str, pattern: str) -> str:
    """[gap, match, gap, match, …, gap] in one pass of the pattern over the text."""
    safe = f"replace({text}, {lit(MARK)}, ' ')"
    return f"split(regexp_replace({safe}, {lit(pattern)}, {lit(MARK + '$0' + MARK)}), {lit(MARK)}, -1)"


def candidates(text: str, pattern: str, guard: str | None = None, beside: bool = False) -> str:
    """All non-overlapping matches, left to right, with byte offsets.

    ``beside`` adds both neighbour characters, ``before`` and ``after`` ('' at an end of the text).

    ``guard`` is a cheaper pattern that occurs in every text with a match; most texts then stop there.
    """

    def neighbours(parts: str, i: str) -> dict[str, str]:
        return dict(
            before=let(f"get({parts}, {i} - 1)", lambda p: f"right(if({p} <> '', {p}, coalesce(get({parts}, {i} - 2), '')), 1)"),
            after=let(f"get({parts}, {i} + 1)", lambda p: f"left(if({p} <> '', {p}, coalesce(get({parts}, {i} + 2), '')), 1)"),
        )

    def word(parts: str, starts: str, i: str) -> str:
        """The mark is a blank to the pattern; in a text that holds one, words are cut from the text itself."""
        own = cut(f"cast({text} as binary)", f"{starts}[{i}]", f"({starts}[{i}] + octet_length({parts}[{i}]))")
        return f"if(contains({text}, {lit(MARK)}), {own}, {parts}[{i}])"

    def located(parts: str) -> str:
        index = fresh("i")
        matches = f"filter(sequence(0, size({parts}) - 1), {index} -> {index} % 2 = 1)"

        def placed(starts: str) -> str:
            return each(
                matches,
                lambda i: struct(
                    start=f"{starts}[{i}]",
                    end=f"{starts}[{i}] + octet_length({parts}[{i}])",
                    word=word(parts, starts, i),
                    **(neighbours(parts, i) if beside else {}),
                ),
            )

        return let(prefix_sums(each(parts, lambda p: f"octet_length({p})")), placed)

    return f"if({text} rlike {lit(guard or pattern)}, {let(marked_parts(text, pattern), located)}, {empty(NEIGHBOURED if beside else CANDIDATE)})"


def quoted(literal: str) -> str:
    """SQL: a Java pattern that matches exactly the text in ``literal``."""
    return f"concat({lit(chr(92) + 'Q')}, replace({literal}, {lit(chr(92) + 'E')}, {lit(chr(92) + 'E' + chr(92) * 2 + 'E' + chr(92) + 'Q')}), {lit(chr(92) + 'E')})"


def literal_ranges(text: str, needle: str) -> str:
    """Non-overlapping occurrences of a non-empty literal, left to right."""

    def located(gaps: str) -> str:
        def placed(starts: str) -> str:
            return each_indexed(
                f"slice({gaps}, 1, size({gaps}) - 1)",
                lambda gap, i: struct(
                    start=f"{starts}[{i}] + octet_length({gap})",
                    end=f"{starts}[{i}] + octet_length({gap}) + octet_length({needle})",
                ),
            )

        return let(prefix_sums(each(gaps, lambda gap: f"octet_length({gap}) + octet_length({needle})")), placed)

    return f"if(contains({text}, {needle}), {let(f'split({text}, {quoted(needle)}, -1)', located)}, {empty(RANGE)})"


def is_boundary(raw: str, position: str) -> str:
    """The byte at this position does not continue a character."""
    return f"not (hex(substring({raw}, {position} + 1, 1)) rlike '^[89AB]')"


def valid_hit(raw: str, hit: str) -> str:
    return (
        f"({hit}.start >= 0 and {hit}.start <= {hit}.end and {hit}.end <= octet_length({raw})"
        f" and {is_boundary(raw, hit + '.start')} and {is_boundary(raw, hit + '.end')})"
    )


def trimmed(raw: str, start: str, end: str) -> str:
    """Range without white space at both ends; a blank range stays as it is."""

    def inner(word: str) -> str:
        lead = f"octet_length({word}) - octet_length(ltrim({lit(WHITE_SPACE)}, {word}))"
        tail = f"octet_length({word}) - octet_length(rtrim({lit(WHITE_SPACE)}, {word}))"
        blank = f"ltrim({lit(WHITE_SPACE)}, {word}) = ''"
        return struct(start=f"if({blank}, {start}, {start} + {lead})", end=f"if({blank}, {end}, {end} - ({tail}))")

    return let(cut(raw, start, end), inner)


def _run_length(window, pattern: str, sizes: tuple[int | None, ...] = (64, 16384, None)) -> str:
    """Length of an ASCII run at one end; looks at a short window first and widens only while the run fills it."""
    size, rest = sizes[0], sizes[1:]
    length = f"octet_length(regexp_extract({window(size)}, {lit(pattern)}, 0))"
    if size is None:
        return length
    return let(length, lambda n: f"if({n} < {size}, {n}, {_run_length(window, pattern, rest)})")


def run_before(raw: str, position: str, characters: str) -> str:
    def window(size: int | None) -> str:
        if size is None:
            return f"cast(substring({raw}, 1, {position}) as string)"
        return f"cast(substring({raw}, greatest({position} - {size}, 0) + 1, least({position}, {size})) as string)"

    return _run_length(window, rf"(?<![{characters}])[{characters}]*+\z")


def run_after(raw: str, position: str, characters: str) -> str:
    def window(size: int | None) -> str:
        length = f"octet_length({raw})" if size is None else size
        return f"cast(substring({raw}, {position} + 1, {length}) as string)"

    return _run_length(window, rf"\A[{characters}]*+")


def completed(raw: str, start: str, end: str, characters: str) -> str:
    """Range grown outward over characters of the same token."""
    return struct(
        start=f"{start} - {run_before(raw, start, characters)}",
        end=f"{end} + {run_after(raw, end, characters)}",
    )


def widened(raw: str, start: str, end: str) -> str:
    """Range grown to character boundaries (a character has at most three continuation bytes)."""
    back = "coalesce(" + ", ".join(f"if({is_boundary(raw, f'{start} - {k}')}, {start} - {k}, null)" for k in range(4)) + f", {start})"
    ahead = "coalesce(" + ", ".join(f"if({is_boundary(raw, f'{end} + {k}')}, {end} + {k}, null)" for k in range(4)) + f", {end})"
    return struct(start=back, end=ahead)


def overlaps(a: str, b: str) -> str:
    """Strict overlap; touching ranges stay apart."""
    return f"({a}.start < {b}.end and {b}.start < {a}.end)"


def subtract(start: str, end: str, holes: str) -> str:
    """Pieces of [start, end) outside ``holes`` (sorted, disjoint)."""

    def pieces(hit: str) -> str:
        pairs = each_indexed(
            f"array_append({hit}, {struct(start=end, end=end)})",
            lambda hole, i: struct(
                start=f"if({i} = 0, {start}, get({hit}, {i} - 1).end)",
                end=f"{hole}.start",
            ),
        )
        return keep(pairs, lambda p: f"{p}.start < {p}.end")

    return let(keep(holes, lambda h: f"{h}.end > {start} and {h}.start < {end}"), pieces)


def replaced(raw: str, ranges: str, placeholder) -> str:
    """Text with every range (sorted, disjoint) replaced."""

    def body(r: str) -> str:
        pieces = each_indexed(
            r,
            lambda x, i: f"concat({cut(raw, f'coalesce(get({r}, {i} - 1).end, 0)', f'{x}.start')}, {placeholder(x)})",
        )
        tail = cut(raw, f"coalesce(get({r}, size({r}) - 1).end, 0)", f"octet_length({raw})")
        return f"concat(array_join({pieces}, ''), {tail})"

    return let(ranges, body)

