"""Periodic runs of words: an online search for squares with catchers over completed blocks of power-of-two lengths.

For blocks of m words a catcher is set on every aligned block as soon as it is complete. It follows the words that are
appended after it and compares the suffix of the last m words with its block, as long as the two lie 2m-1 to 4m-2 words
apart; after every word two catchers of a size are at work. A square whose half has that many words holds an aligned
block of m words in its first half, so one catcher meets it, and the sizes 1, 2, 4, ... share all periods among them.
Meetings of neighbouring blocks at one distance are the same square moved on: they are merged, lengthened at both ends
by less than a block, and are runs once they are long enough.

Catchers of one size do not depend on those of another, so sizes are advanced one after the other over the words of
many texts at once, as columns of numbers. Suffixes are compared by hashes put together from those of their halves; every run
found is compared word by word, and if a hash has lied the search is repeated with other hashes.
"""

from __future__ import annotations

from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanguard.llm.bytetext import mixed, slices

RUN = "struct<start:long,length:long,period:long>"
LEAST_WORDS, LEAST_EXPONENT = 24, 3


def _first_names(ids: np.ndarray, seed: int) -> np.ndarray:
    """A hash for each word number; numbers below zero are like no other word."""
    return mixed(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 2 + 1) * 0x2545F4914F6CDD1D % (1 << 64)))


def _doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Names of stretches of twice the size from those of their halves."""
    return mixed(names[:-size] * np.uint64(0xD1342543DE82EF95) + (names[size:] ^ np.uint64(0xA0761D6478BD642F)))


def _met(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, block) wherever the suffix ending at a word equals the block of one of the two catchers at work there."""
    blocks = names[::size]
    periods, at = [], []
    for nearest in (2 * size - 1, 3 * size - 1):  # the suffix begins this many words or up to size - 1 more behind its block
        if len(names) <= nearest:
            continue
        caught = np.repeat(blocks, size)[: len(names) - nearest]
        behind = np.flatnonzero(names[nearest:] == caught)
        periods.append(nearest + behind % size)
        at.append(behind // size)
    return (np.concatenate(periods), np.concatenate(at)) if periods else (np.zeros(0, np.int64),) * 2


def _merged(periods: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(period, first block, last block) of neighbouring blocks that met at one distance."""
    order = np.lexsort((blocks, periods))
    periods, blocks = periods[order], blocks[order]
    new = np.ones(len(periods), bool)
    new[1:] = (np.diff(periods) != 0) | (np.diff(blocks) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(periods))[: len(first)] - 1
    return periods[first], blocks[first], blocks[last]


def _lengthened(names: list[np.ndarray], periods, starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Stretches whose words equal those a period on, grown by less than a block at both ends; a halving search."""
    starts, ends = starts.copy(), ends.copy()
    for half in reversed(range(len(names) - 1)):
        step, name = 1 << half, names[half]
        left = np.flatnonzero(starts >= step)
        left = left[name[starts[left] - step] == name[starts[left] - step + periods[left]]]
        starts[left] -= step
        right = np.flatnonzero(ends + periods + step <= len(names[0]))
        right = right[name[ends[right]] == name[ends[right] + periods[right]]]
        ends[right] += step
    return starts, ends


def _squares(ids: np.ndarray, reach, seed: int, least_words: int, least_exponent: int):
    """Runs (start, length, period) over all sizes of catchers; ``reach(period)``: how many words hold texts that long."""
    names, size, found = [_first_names(ids, seed)], 1, []
    while True:
        usable = reach(least_exponent * (2 * size - 1))
        if usable <= size:
            break
        periods, blocks = _met(names[-1][: max(0, usable - size + 1)], size)
        periods, first, last = _merged(periods, blocks)
        # A stretch grows by less than a block at both ends: what stays too short even so is no run.
        long = (last - first + 1) * size + 2 * (size - 1) + periods >= np.maximum(least_words, least_exponent * periods)
        periods, first, last = periods[long], first[long], last[long]
        starts, ends = _lengthened(names, periods, first * size, (last + 1) * size)
        lengths = ends - starts + periods
        long = lengths >= np.maximum(least_words, least_exponent * periods)
        found.append(np.stack([starts[long], lengths[long], periods[long]], 1))
        if 2 * size > len(ids):
            break
        names.append(_doubled(names[-1], size))
        size *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # A run of period q is one of 2q, 3q, ... too; its smallest period comes first.
    again = (np.diff(runs[:, 0]) == 0) & (np.diff(runs[:, 1]) == 0)
    return runs[np.append(True, ~again)] if len(runs) else runs


def runs_of(texts: list[np.ndarray], least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> list[np.ndarray]:
    """Of each text, given as numbers of its words (0 or more), its runs as rows (start, length, period) by start, then period.

    A run is a stretch of words with smallest period q and at least ``least_words`` and ``least_exponent`` · q words
    that no neighbouring word extends; ``least_exponent`` is 2 or more.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # long texts first: large blocks see the front only
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])  # behind each text one word that is like no other
    ids = np.empty(begins[-1], np.int64)
    for place, i in enumerate(order):
        ids[begins[place] : begins[place + 1] - 1] = texts[i]
        ids[begins[place + 1] - 1] = -1 - place

    def reach(least: int) -> int:
        return int(begins[np.searchsorted(-sizes, -least, side="right")])

    for seed in count():
        runs = _squares(ids, reach, seed, least_words, least_exponent)
        if all(np.array_equal(ids[s : s + n - p], ids[s + p : s + n]) for s, n, p in runs.tolist()):
            break
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    runs = runs - np.stack([begins[owner], np.zeros_like(owner), np.zeros_like(owner)], 1)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    found = [runs[:0]] * len(texts)
    for place, i in enumerate(order):
        found[i] = runs[edges[place] : edges[place + 1]]
    return found


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Flags of the words that stand in a run behind its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def _searched(column: str, words: str, found: str, collapsed: str, least_words: int, least_exponent: int, schema: list[str]):
    def run(batches):
        for batch in slices(batches, column):
            texts = [(t or "").encode().split() for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]  # white space of bytes is [\x20\x09-\x0D]
            flat = pa.array(chain.from_iterable(texts), pa.large_binary()).dictionary_encode().indices.to_numpy()
            edges = np.cumsum([0, *map(len, texts)])
            runs = runs_of([flat[a:b] for a, b in zip(edges, edges[1:])], least_words, least_exponent)
            kept = []
            for text, own in zip(texts, runs):
                if len(own):
                    gone = repeated(own, len(text))
                    text = [w for w, g in zip(text, gone.tolist()) if not g]
                kept.append(b" ".join(text))
            rows = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            listed = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), listed)
            own = {words: pa.array(np.diff(edges), pa.int64()), found: lists, collapsed: pa.array(kept, pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_arrays([own[n] if n in own else batch.column(batch.schema.get_field_index(n)) for n in schema], names=schema)

    return run


def with_runs(
    df: DataFrame,
    text: str = "text",
    words: str = "n_words",
    runs: str = "runs",
    collapsed: str = "collapsed",
    least_words: int = LEAST_WORDS,
    least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """Adds the number of words, the runs (``array<struct<start, length, period>>``, in words from 0, by start, then period) and
    the text without its repetitions: its words joined by one space, without those in a run behind its first period.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words, no runs and an empty rest. Texts are read whole, of
    any length, one after the other; every row is answered alone, so repeated rows, null keys and further columns
    change nothing, and an empty table gives none. Columns that exist already under the three names are refused.
    """
    if taken := {words, runs, collapsed} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} are taken")
    if least_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    names = [*df.columns, words, runs, collapsed]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{words}` long", f"`{runs}` array<{RUN}>", f"`{collapsed}` string"]
    return df.mapInArrow(_searched(text, words, runs, collapsed, least_words, least_exponent, names), ", ".join(kinds))


def strongest(runs: str) -> F.Column:
    """Of a column of runs the one with the greatest length / period (exactly), then the smallest start and period; null if none."""
    first = f"(a, b) -> case when a.length * b.period <> b.length * a.period then cast(sign(b.length * a.period - a.length * b.period) as int) when a.start <> b.start then cast(sign(a.start - b.start) as int) else cast(sign(a.period - b.period) as int) end"
    return F.expr(f"get(array_sort(`{runs}`, {first}), 0)")
