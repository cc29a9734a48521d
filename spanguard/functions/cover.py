"""Ranges of very many rows held against each other at once, as numbers: sorted and swept, no two of them are compared.

Rows are laid on one line, each behind the last one, so ranges of different rows never meet.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


def on_one_line(rows: list[np.ndarray], ranges: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    width = 2 + max((int(e.max(initial=0)) for _, e in ranges), default=0)
    return [(s + r * width, e + r * width) for r, (s, e) in zip(rows, ranges)]


def _reach(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    return start[order], np.maximum.accumulate(end[order])


def covered(start: np.ndarray, end: np.ndarray, by_start: np.ndarray, by_end: np.ndarray) -> np.ndarray:
    """Which ranges lie in one of the others."""
    if not len(by_start):
        return np.zeros(len(start), bool)
    begins, reach = _reach(by_start, by_end)
    n = np.searchsorted(begins, start, side="right")
    return (n > 0) & (reach[n - 1] >= end)


def touched(start: np.ndarray, end: np.ndarray, by_start: np.ndarray, by_end: np.ndarray) -> np.ndarray:
    """Which ranges strictly overlap one of the others."""
    if not len(by_start):
        return np.zeros(len(start), bool)
    begins, reach = _reach(by_start, by_end)
    n = np.searchsorted(begins, end, side="left")
    return (n > 0) & (reach[n - 1] > start)


def held(start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which ranges lie in a range with a smaller place."""
    out = np.zeros(len(start), bool)
    order = np.lexsort((place, -end, start))
    s, e, p = start[order], end[order], place[order]
    before = np.concatenate([[-1], np.maximum.accumulate(e)[:-1]]) if len(e) else e
    run = np.cumsum(s >= before)
    mixed = np.zeros(int(run.max(initial=0)) + 1, bool)
    mixed[run[before >= e]] = True
    asked = np.flatnonzero(mixed[run])
    ends, places, last = [], [], -1  # ranges so far that no other one both reaches beyond and comes before, by end
    for i, r, x, y in zip(order[asked].tolist(), run[asked].tolist(), e[asked].tolist(), p[asked].tolist()):
        if r != last:
            ends, places, last = [], [], r
        j = bisect_left(ends, x)
        if j < len(ends) and places[j] < y:
            out[i] = True
            continue
        low = j
        while low and places[low - 1] > y:
            low -= 1
        high = j + (j < len(ends) and ends[j] == x)
        ends[low:high], places[low:high] = [x], [y]
    return out


def overruled(start: np.ndarray, end: np.ndarray, priority: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which ranges strictly overlap one of another kind (of two) and of higher priority."""
    out = np.zeros(len(start), bool)
    levels, level = np.unique(priority, return_inverse=True)
    parts = [(np.arange(len(start)), 0, len(levels))]
    while parts:  # ranges of the lower half of the levels against those of the upper one, then each half in itself
        mine, low, high = parts.pop()
        if high - low < 2 or len(mine) < 2:
            continue
        middle = (low + high) // 2
        upper = level[mine] >= middle
        above, below = mine[upper], mine[~upper]
        for k in (False, True):
            x, y = below[kind[below] == k], above[kind[above] != k]
            out[x] |= touched(start[x], end[x], start[y], end[y])
        parts += [(below, low, middle), (above, middle, high)]
    return out


def unions(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where, in ranges sorted by start, one begins that no earlier one strictly overlaps."""
    if not len(start):
        return np.zeros(0, np.int64)
    reach = np.maximum.accumulate(end)
    return np.flatnonzero(np.concatenate([[True], start[1:] >= reach[:-1]]))
