"""Token ids of whole columns of text with a public tokenizer whose pieces can be encoded one by one.

A text is cut where the tokenizer's own rules always cut: at ASCII white space, between an ASCII letter, digit and other
sign, and between digits; never beside an apostrophe or a character outside ASCII. Each different piece is encoded once by
the tokenizers library and found again by its 64-bit hash; texts that hold one of the tokenizer's special tokens are encoded
as a whole. Tests hold the ids against encoding every text as a whole.
"""

from __future__ import annotations

import os

import numpy as np

from spanguard.llm.bytetext import FOLD, NOT_SPACE, Hasher, admits, cuts, text_bytes
from spanguard.llm.worker import kept

MOST_PIECES = 1 << 19
END = 1
_KIND = np.full(256, 3, np.uint8)
_KIND[admits((0x41, 0x5A), (0x61, 0x7A))] = 1
_KIND[admits((0x30, 0x39))] = 2
_KIND[0x80:] = 0
_KIND[0x27] = 0
#: Whether a piece ends between two bytes of these kinds (0: never cut beside it).
_CUT = np.array([[0, 0, 0, 0], [0, 0, 1, 1], [0, 1, 1, 1], [0, 1, 1, 0]], bool)


class Table:
    """Open addressing in numpy: 64-bit hashes to small numbers."""

    def __init__(self, most: int):
        self.mask = (1 << (2 * most - 1).bit_length()) - 1
        self.keys, self.values, self.used, self.most = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32), 0, most

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where there is none."""
        slots = (hashes & np.uint64(self.mask)).astype(np.int64)
        there = self.keys[slots]
        out = np.where(there == hashes, self.values[slots], -1)
        rest = np.flatnonzero((there != hashes) & (there != 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.mask
            there = self.keys[slots[rest]]
            same = there == hashes[rest]
            out[rest[same]] = self.values[slots[rest[same]]]
            rest = rest[~same & (there != 0)]
        return out

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """New and different hashes."""
        slots = (hashes & np.uint64(self.mask)).astype(np.int64)
        rest = np.arange(len(hashes))
        while len(rest):
            free = rest[self.keys[slots[rest]] == 0]
            _, first = np.unique(slots[free], return_index=True)
            won = free[first]
            self.keys[slots[won]], self.values[slots[won]] = hashes[won], values[won]
            rest = rest[self.keys[slots[rest]] != hashes[rest]]
            slots[rest] = (slots[rest] + 1) & self.mask
        self.used += len(hashes)


class Encoder:
    """One for each Python worker; what it has encoded is forgotten when ``MOST_PIECES`` are held."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.hasher = Hasher(FOLD)
        self._forget()

    def _forget(self) -> None:
        self.table = Table(MOST_PIECES)
        self.ids, self.held = np.array([END] + [0] * (1 << 16), self.wide), 1
        self.first, self.count, self.pieces = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int32), 1  # piece 0: the end

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in encoded], np.int32)
        flat = np.array([i for x in encoded for i in x], self.wide)
        while self.held + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), self.wide)])
        while self.pieces + len(texts) > len(self.first):
            self.first, self.count = np.concatenate([self.first, self.first * 0]), np.concatenate([self.count, self.count * 0])
        new = slice(self.pieces, self.pieces + len(texts))
        self.ids[self.held : self.held + len(flat)] = flat
        self.count[new] = sizes
        self.first[new] = self.held + np.cumsum(sizes) - sizes
        self.table.add(hashes, np.arange(new.start, new.stop, dtype=np.int32))
        self.held, self.pieces = self.held + len(flat), new.stop

    def _chunk(self, part: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces of a chunk and their numbers."""
        inside = np.take(NOT_SPACE, part)
        kind = np.take(_KIND, part)
        opens, closes = inside.copy(), inside.copy()
        same = inside[1:] & inside[:-1] & ~_CUT.ravel()[kind[:-1] * 4 + kind[1:]]
        opens[1:] &= ~same
        closes[:-1] &= ~same
        opens[breaks] = inside[breaks]
        before = breaks[breaks > 0] - 1
        closes[before] = inside[before]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        hashes = self.hasher.runs(part, starts, ends)
        numbers = self.table.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, where = np.unique(hashes[missing], return_index=True)
            if self.table.used + len(new) > MOST_PIECES:
                self._forget()
                return self._chunk(part, breaks)
            texts = [part[starts[m] : ends[m]].tobytes().decode("utf-8", "replace") for m in missing[where].tolist()]
            self._learn(new, texts)
            numbers[missing] = self.table.find(hashes[missing])
        return starts, numbers

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, each with the end id behind it, and the offsets of the texts in them. Null is empty."""
        raw, bounds = text_bytes(column)
        flats, lengths, seen = [], [], 0
        edges = cuts(raw, NOT_SPACE, bounds)
        sizes = np.zeros(len(bounds) - 1, np.int64)
        for low, high in zip(edges, edges[1:]):
            lo, hi = int(np.searchsorted(bounds, low)), int(np.searchsorted(bounds, high))
            starts, numbers = self._chunk(raw[low:high], bounds[lo:hi] - low)
            counts = self.count[numbers].astype(np.int64)
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            flats.append(self.ids[np.repeat(self.first[numbers] - ends + counts, counts) + np.arange(total)])
            rows = np.searchsorted(bounds, starts + low, side="right") - 1
            sizes += np.bincount(rows, counts, minlength=len(sizes)).astype(np.int64)
        flat = np.concatenate(flats) if flats else np.zeros(0, self.wide)
        before = np.concatenate([[0], np.cumsum(sizes)])
        texts_with = [r for s in self.special if (r := self._rows_with(raw, bounds, s))]
        whole = sorted({row for rows in texts_with for row in rows})
        if whole:
            parts = [flat[before[i] : before[i + 1]] for i in range(len(sizes))]
            for row in whole:
                parts[row] = np.array(self.tokenizer.encode(raw[bounds[row] : bounds[row + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, self.wide)
            sizes = np.array([len(p) for p in parts])
            flat, before = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        return np.insert(flat, before[1:], self.wide(END)), before + np.arange(len(before))

    @staticmethod
    def _rows_with(raw: np.ndarray, bounds: np.ndarray, needle: bytes) -> list[int]:
        data, at, rows = raw.tobytes(), 0, []
        while (at := data.find(needle, at)) >= 0:
            row = int(np.searchsorted(bounds, at, side="right")) - 1
            if at + len(needle) <= bounds[row + 1]:
                rows.append(row)
            at += 1
        return rows


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), lambda: Encoder(path))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

