"""Words of whole Arrow columns of text at once: UTF-8 bytes in numpy, in chunks of bounded size.

A word is a maximal run of bytes that a table of 256 flags admits, inside one text. Its hash is a polynomial over random
values of its folded bytes, finished with its length, so equal words have equal hashes wherever they stand. Texts of any
length are cut between words only; null is an empty text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 17
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def admits(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes that are no white space: the class ``[^\x20\x09-\x0D]``.
NOT_SPACE = ~admits((0x20, 0x20), (0x09, 0x0D))
#: Digits, small letters and all that is no ASCII: the class ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after folding.
ALPHANUMERIC = admits((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Folds A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings and the offsets of its rows in them (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finish of 64-bit hashes."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


class Hasher:
    """Hashes runs of bytes; one for each folding of bytes."""

    def __init__(self, fold: np.ndarray = FOLD):
        rng = np.random.default_rng(20240229)
        self.fold = fold
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)[fold]
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.reserve(CHUNK + 1)

    def reserve(self, length: int) -> None:
        if len(self.powers) < length:
            with np.errstate(over="ignore"):
                self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(length - 1, _BASE, np.uint64))])
                self.inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(length - 1, _BASE_INVERSE, np.uint64))])

    def runs(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self.reserve(len(raw) + 1)
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(np.take(self.values, raw) * self.powers[: len(raw)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


def cuts(raw: np.ndarray, inside: np.ndarray, bounds: np.ndarray, size: int = CHUNK) -> list[int]:
    """Places to cut the bytes into chunks of about ``size``: where a text begins or no word goes on."""
    places, at = [0], 0
    while len(raw) - at > size:
        at += size
        while at < len(raw) and inside[raw[at]] and inside[raw[at - 1]]:
            row = np.searchsorted(bounds, at)
            if bounds[row] == at:
                break
            step = min(len(raw), at + 4096, int(bounds[row]))
            gap = np.flatnonzero(~inside[raw[at:step]])
            at = at + int(gap[0]) if len(gap) else step
        if at >= len(raw):
            break
        places.append(at)
    return [*places, len(raw)]


def run_bounds(part: np.ndarray, breaks: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in a chunk; ``breaks``: where texts begin in it."""
    flags = np.take(inside, part)
    opens, closes = flags.copy(), flags.copy()
    opens[1:] &= ~flags[:-1]
    closes[:-1] &= ~flags[1:]
    opens[breaks] = flags[breaks]
    before = breaks[breaks > 0] - 1
    closes[before] = flags[before]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def words(column, inside: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column in order, and the offsets of its rows in them."""
    raw, bounds = text_bytes(column)
    hashes, places = [], []
    edges = cuts(raw, inside, bounds)
    for low, high in zip(edges, edges[1:]):
        part = raw[low:high]
        breaks = bounds[np.searchsorted(bounds, low) : np.searchsorted(bounds, high)] - low
        starts, ends = run_bounds(part, breaks, inside)
        hashes.append(hasher.runs(part, starts, ends))
        places.append(starts + low)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), bounds)


def slices(batches, column: str, size: int = 4 << 20):
    """Batches cut into slices of rows with at most ``size`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
