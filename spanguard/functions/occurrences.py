"""Occurrences of many literals in one text, in one pass: a helper for Arrow batch functions.

Searching values one by one multiplies the text by their number; here a text is read once for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def automaton(values: Sequence[str]):
    """An automaton over non-empty values, each with the tuple of its indexes."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for index, value in enumerate(values):
        if value:
            machine.add_word(value, (*machine.get(value, ()), index))
    machine.make_automaton()
    return machine


def byte_offsets(text: str) -> np.ndarray:
    """Byte offset of every character position, end included."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate(([0], np.cumsum(sizes)))


def literal_occurrences(text: str, values: Sequence[str]) -> list[list[tuple[int, int]]]:
    """Per value its non-overlapping occurrences from left to right, in bytes."""
    offsets = byte_offsets(text)
    found: list[list[tuple[int, int]]] = [[] for _ in values]
    reached = [0] * len(values)

    def add(index: int, first: int) -> None:
        if first >= reached[index]:
            reached[index] = first + len(values[index])
            found[index].append((int(offsets[first]), int(offsets[reached[index]])))

    machine = automaton(values)
    if len(machine):
        for last, indexes in machine.iter(text):
            for index in indexes:
                add(index, last + 1 - len(values[index]))
    return found
