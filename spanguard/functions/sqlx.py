"""Small builders for Spark SQL expression text.

Span logic lives in array columns, so that a text never leaves its row and nothing is shuffled.  The array logic is
written as SQL expression text (one ``F.expr`` per stage): it is parsed once, stays in the JVM, and lets us bind an
intermediate value with :func:`let` where Catalyst would otherwise inline it into every use.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import count

_names = count()
_PLAIN = re.compile(r"[A-Za-z0-9 _.:,@/#-]*\Z")

#: Items per block of the two-level prefix functions; n items cost about n * (BLOCK + n / BLOCK**2) / 2 steps.
BLOCK = 64


def fresh(prefix: str = "v") -> str:
    """A lambda variable name that no enclosing lambda uses."""
    return f"{prefix}_{next(_names)}"


def lit(value: object) -> str:
    """SQL literal.  Text beyond a plain alphabet goes through a hex literal, so no quoting mode can change it."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"cast('{value!r}' as double)"
    text = str(value)
    if _PLAIN.match(text):
        return f"'{text}'"
    return f"cast(X'{text.encode().hex()}' as string)"


def let(value: str, body: Callable[[str], str]) -> str:
    """Bind ``value`` once and use it many times in ``body``."""
    name = fresh()
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def each(array: str, body: Callable[[str], str]) -> str:
    name = fresh("x")
    return f"transform({array}, {name} -> {body(name)})"


def each_indexed(array: str, body: Callable[[str, str], str]) -> str:
    name, index = fresh("x"), fresh("i")
    return f"transform({array}, ({name}, {index}) -> {body(name, index)})"


def keep(array: str, test: Callable[[str], str]) -> str:
    name = fresh("x")
    return f"filter({array}, {name} -> {test(name)})"


def some(array: str, test: Callable[[str], str]) -> str:
    name = fresh("x")
    return f"exists({array}, {name} -> {test(name)})"


def fold(array: str, zero: str, merge: Callable[[str, str], str], finish: Callable[[str], str] | None = None) -> str:
    acc, item = fresh("a"), fresh("x")
    tail = ""
    if finish is not None:
        end = fresh("a")
        tail = f", {end} -> {finish(end)}"
    return f"aggregate({array}, {zero}, ({acc}, {item}) -> {merge(acc, item)}{tail})"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def empty(item: str) -> str:
    return f"cast(array() as array<{item}>)"


def _blockwise(array: str, block_value: Callable[[str], str], base: Callable[[str, str], str], item) -> str:
    """Exclusive prefix values of an array in two levels: over blocks, then inside each block.

    A fold that carries its result along is copied at every step and therefore quadratic; here nothing is carried.
    """

    def over_blocks(a: str) -> str:
        last = f"(size({a}) - 1) div {BLOCK}"
        blocks = f"sequence(0, {last})"

        def one(values: str, k: str) -> str:
            first = f"{k} * {BLOCK} + 1"
            return let(
                base(values, k),
                lambda b: each_indexed(f"slice({a}, {first}, {BLOCK})", lambda x, i: item(b, f"slice({a}, {first}, {i})")),
            )

        per_block = each(blocks, lambda k: block_value(f"slice({a}, {k} * {BLOCK} + 1, {BLOCK})"))
        prefix = let(per_block, lambda values: f"flatten({each(blocks, lambda k: one(values, k))})")
        return f"if(size({a}) = 0, null, {prefix})"

    return let(array, over_blocks)


def _sum(numbers: str) -> str:
    return fold(numbers, "0", lambda acc, x: f"{acc} + {x}")


def prefix_sums(numbers: str) -> str:
    """For every item of an array<int> the sum of the items before it."""
    return _blockwise(numbers, _sum, lambda sums, k: _sum(f"slice({sums}, 1, {k})"), lambda b, before: f"{b} + {_sum(before)}")


def prefix_max(values: str) -> str:
    """For every item the greatest item before it, null for the first."""
    return _blockwise(
        values,
        lambda block: f"array_max({block})",
        lambda tops, k: f"array_max(slice({tops}, 1, {k}))",
        lambda b, before: f"greatest({b}, array_max({before}))",
    )


def islands(array: str, item: str, key: str | None = None) -> str:
    """Split items sorted by (key,) start into runs that are connected by strict overlap.

    Items need ``start`` and ``end``.  A run begins where no earlier item (of the same key, which is then the greatest
    so far) reaches beyond the start.  Whatever needs pairs of overlapping items then only looks inside one run, so a
    text with very many hits never compares all of them with each other.
    """

    def reach_of(x: str) -> str:
        return struct(**({} if key is None else {"key": f"{x}.{key}"}), end=f"{x}.end")

    def opens(x: str, before: str) -> str:
        test = f"{before} is null or {x}.start >= {before}.end"
        return test if key is None else f"{test} or {x}.{key} <> {before}.key"

    def cut(a: str, reach: str) -> str:
        index = fresh("i")
        firsts = f"filter(sequence(0, size({a}) - 1), {index} -> {opens(f'{a}[{index}]', f'{reach}[{index}]')})"
        return let(
            firsts,
            lambda f: each_indexed(f, lambda s, j: f"slice({a}, {s} + 1, coalesce(get({f}, {j} + 1), size({a})) - {s})"),
        )

    def runs(a: str) -> str:
        return f"if(size({a}) = 0, {empty(f'array<{item}>')}, {let(prefix_max(each(a, reach_of)), lambda r: cut(a, r))})"

    return let(array, runs)


def hash_chain(digests: str, root: str) -> str:
    """SQL: all links of a chain of SHA-256 over an array of hex digests, 64 characters each, in one string."""
    step = "sha2(concat(if({acc} = '', {root}, right({acc}, 64)), {x}), 256)"
    return fold(digests, "cast('' as string)", lambda acc, x: f"concat({acc}, {step.format(acc=acc, root=root, x=x)})")


def link(chain_binary: str, index: str) -> str:
    """SQL: one link of a chain that was cast to binary (cutting binary does not read what comes before)."""
    return f"cast(substring({chain_binary}, {index} * 64 + 1, 64) as string)"
