"""Finding very many phrases in texts with a table of numbers: no phrase is shipped, only hashes of it.

A phrase is looked for by its first characters: hashes of all windows of 1, 2, 4, 8, 12 or 16 characters are made for whole batches at
once and held against the sorted hashes of beginnings. Where a beginning matches, the window of each length a phrase with it has
is hashed in turn, and what matches that too is confirmed by a digest of 128 bits of the window as it stands in the text.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

from spanguard.functions.worker import once

SIZES = (1, 2, 4, 8, 12, 16)
#: Characters whose hashes are made at once.
PIECE = 1 << 18
#: Stands between two texts; no character has this number.
GAP = 0x110000
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def folded(character: str) -> str:
    """One character for one character; equal lower-cased texts of equal length fold to equal texts."""
    lowered = character.lower()
    if len(lowered) != 1:
        return character
    return "σ" if lowered == "ς" else lowered


def digest(text: str, exact: bool) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, key=b"exact" if exact else b"folded").digest()


def _finished(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def _character_values() -> np.ndarray:
    points = np.fromiter((ord(folded(chr(i))) if i < GAP else GAP for i in range(GAP + 1)), np.uint64, GAP + 1)
    return _finished(points + np.uint64(0x5851F42D4C957F2D))


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(19, (length - 1).bit_length())

    def make():
        ones = np.ones(1, np.uint64)
        return tuple(np.concatenate([ones, np.cumprod(np.full(size - 1, base, np.uint64))]) for base in (_STEP, _BACK))

    return once(("phrase powers", size), make)


class Windows:
    """Hashes of any windows of a row of folded characters."""

    def __init__(self, points: np.ndarray):
        values = once("phrase characters", _character_values)
        ahead, self.back = _powers(len(points) + 1)
        self.length, self.sums = len(points), np.zeros(len(points) + 1, np.uint64)
        np.cumsum(values[points] * ahead[: len(points)], out=self.sums[1:])

    def every(self, size: int, most: int) -> np.ndarray:
        """The hash of the window of ``size`` at each of the first ``most`` places where one fits."""
        n = max(0, min(most, self.length - size + 1))
        return _finished((self.sums[size : size + n] - self.sums[:n]) * self.back[:n] + np.uint64(size))

    def at(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _finished((self.sums[places + sizes] - self.sums[places]) * self.back[places] + sizes.astype(np.uint64))


class Texts:
    """The texts of an Arrow array as one row of characters, a gap behind each; null texts are empty."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        texts = texts.fill_null("") if texts.null_count else texts
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
        #: Where the bytes of each text begin.
        self.byte_begins = ends - ends[0]
        plain = not len(self.data) or self.data.max() < 0x80
        flat = self.data if plain else np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        firsts = self.byte_begins if plain else np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])[self.byte_begins]
        #: Where the characters of each text begin.
        self.begins = firsts + np.arange(len(firsts))
        self.points, inside = np.full(self.begins[-1], GAP, np.uint32), np.ones(self.begins[-1], bool)
        inside[self.begins[1:] - 1] = False
        self.points[inside] = flat
        sizes = inside.astype(np.int64)
        if not plain:
            sizes[inside] += (flat > 0x7F).astype(np.int64) + (flat > 0x7FF) + (flat > 0xFFFF)
        #: Bytes before each character; a gap has none.
        self.before = np.concatenate([[0], np.cumsum(sizes)])

    def words(self, at: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Windows of the row of characters as texts."""
        first, lengths = self.before[at], self.before[at + sizes] - self.before[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat(first - ends[:-1], lengths) + np.arange(ends[-1])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(self.data[places]))


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts as numbers, a gap behind each, and where each text begins."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    points = np.full(begins[-1], GAP, np.uint32)
    inside = np.ones(begins[-1], bool)
    inside[begins[1:] - 1] = False
    points[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, begins


def quick_test(hashes: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """A table of the first bits of some hashes, and by how much a hash is shifted to look it up."""
    bits = min(24, max(10, int(len(hashes) * 8).bit_length()))
    quick = np.zeros(1 << bits, bool)
    quick[hashes >> np.uint64(64 - bits)] = True
    return quick, np.uint64(64 - bits)


class Phrases:
    """Phrases by number, ready to be found; about 60 bytes each. Empty phrases are never found."""

    def __init__(self, phrases: list[str], exact: np.ndarray):
        kept = [i for i, p in enumerate(phrases) if p]
        self.exact = np.asarray(exact, bool)[kept]
        self.number = np.array(kept, np.int64)
        self.digest = np.array([digest(phrases[i] if e else phrases[i].lower(), e) for i, e in zip(kept, self.exact)], "V16")
        points, begins = points_of([phrases[i] for i in kept])
        lengths = np.diff(begins) - 1
        self.longest = int(lengths.max(initial=0))
        self.full, beginnings = np.zeros(len(kept), np.uint64), np.zeros(len(kept), np.uint64)
        first = np.array(SIZES)[np.searchsorted(SIZES, lengths, side="right") - 1] if len(kept) else lengths
        for low in range(0, len(kept), 4096):  # in slices: hashing needs three numbers for each character
            high = min(len(kept), low + 4096)
            windows = Windows(points[begins[low] : begins[high]])
            at = begins[low:high] - begins[low]
            self.full[low:high] = windows.at(at, lengths[low:high])
            beginnings[low:high] = windows.at(at, first[low:high])
        self.classes = []  # (size, sorted beginnings, first of their lengths, lengths, quick test, its shift)
        for size in SIZES:
            mine = np.flatnonzero(first == size)
            if len(mine):
                pairs = np.unique(np.stack([beginnings[mine], lengths[mine].astype(np.uint64)], 1), axis=0)
                starts, offsets = np.unique(pairs[:, 0], return_index=True)
                self.classes.append((size, starts, np.append(offsets, len(pairs)), pairs[:, 1].astype(np.int64), *quick_test(starts)))
        order = np.argsort(self.full, kind="stable")
        self.full, self.exact, self.number, self.digest = self.full[order], self.exact[order], self.number[order], self.digest[order]
        self.quick, self.shift = quick_test(self.full)

    def nbytes(self) -> int:
        parts = [self.full, self.quick, self.exact, self.number, self.digest, *(x for c in self.classes for x in c[1:5])]
        return sum(x.nbytes for x in parts)

    def _likely(self, windows: Windows, hashes: dict[int, np.ndarray]):
        """(place, length, whole hash) of windows whose beginning and whole hash are those of a phrase."""
        for size, starts, offsets, lengths, quick, shift in self.classes:
            if size not in hashes:
                hashes[size] = windows.every(size, PIECE)
            made = hashes[size]
            at = np.flatnonzero(quick[made >> shift])
            place = np.minimum(np.searchsorted(starts, made[at]), len(starts) - 1)
            same = starts[place] == made[at]
            at, place = at[same], place[same]
            counts = offsets[place + 1] - offsets[place]
            long = np.repeat(offsets[place] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            at, sizes = np.repeat(at, counts), lengths[long]
            fits = at + sizes <= windows.length
            at, sizes = at[fits], sizes[fits]
            whole = windows.at(at, sizes)
            likely = self.quick[whole >> self.shift]
            at, sizes, whole = at[likely], sizes[likely], whole[likely]
            found = np.searchsorted(self.full, whole)
            good = np.flatnonzero(self.full[np.minimum(found, len(self.full) - 1)] == whole)
            if len(good):
                yield at[good], sizes[good], whole[good]

    def numbers(self, window: str, whole: np.uint64) -> tuple[int, ...]:
        """The phrases that a window is, by its digest."""
        first, after = np.searchsorted(self.full, whole), np.searchsorted(self.full, whole, side="right")
        as_is, low = digest(window, True), digest(window.lower(), False)
        return tuple(int(self.number[i]) for i in range(first, after) if self.digest[i].tobytes() == (as_is if self.exact[i] else low))

    def found(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, place, length, number of the phrase) of every occurrence, also overlapping ones, by text."""
        rows, starts, numbers, words, _ = found_in([self], texts)[0]
        at = np.array([0, *np.cumsum([len(t) + 1 for t in texts])], np.int64)[rows] if len(rows) else rows
        return sorted(zip(rows.tolist(), (starts - at).tolist(), map(len, words), numbers.tolist()))


#: Windows whose phrases are remembered at one time; texts repeat what they hold.
REMEMBERED = 1 << 17


def _confirmed(table: Phrases, known: dict, words: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per window how many phrases it is, and the numbers of all of them one after the other.

    Every different window is made a digest of once; ``known`` remembers its phrases.
    """
    coded = words.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    if len(known) > REMEMBERED:
        known.clear()
    listed = []
    for window, value in zip(distinct, whole[first]):
        if (numbers := known.get(window)) is None:
            numbers = known[window] = table.numbers(window, value)
        listed.append(numbers)
    many = np.fromiter(map(len, listed), np.int64, len(listed))
    begins, flat = np.cumsum(many) - many, np.array([n for x in listed for n in x], np.int64)
    counts = many[codes]
    return counts, flat[np.repeat(begins[codes] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]


def places_in(tables: list[Phrases], texts: Texts, remembered: list[dict]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per table (place among all characters, length, number of the phrase) of every occurrence.

    The windows of the texts are hashed once for all tables.
    """
    longest = max((t.longest for t in tables), default=0)
    parts: list[list] = [[] for _ in tables]
    for low in range(0, len(texts.points) if longest else 0, PIECE):
        windows, hashes = Windows(texts.points[low : low + PIECE + longest]), {}
        for table, known, out in zip(tables, remembered, parts):
            for at, sizes, whole in table._likely(windows, hashes) if len(table.full) else ():
                at = at + low
                counts, numbers = _confirmed(table, known, texts.words(at, sizes), whole)
                out.append((np.repeat(at, counts), np.repeat(sizes, counts), numbers))
    none = np.zeros(0, np.int64)
    return [tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none) for out in parts]


def found_in(tables: list[Phrases], texts: list[str], remembered: list[dict] | None = None) -> list[tuple]:
    """Per table (text, place among all characters, number of the phrase, window, bytes before each character) of every occurrence."""
    read = Texts(pa.array(texts, pa.large_string()))
    found = places_in(tables, read, [{} for _ in tables] if remembered is None else remembered)
    return [(np.searchsorted(read.begins, at, side="right") - 1, at, numbers, np.array(read.words(at, sizes).to_pylist(), object), read.before) for at, sizes, numbers in found]


class Keys:
    """Exact lookup of words by a digest of 128 bits; 24 bytes for each."""

    def __init__(self, words: list[str], exact: np.ndarray):
        both = np.frombuffer(b"".join(digest(w, bool(e)) for w, e in zip(words, exact)), np.uint64).reshape(-1, 2)
        order = np.lexsort((both[:, 1], both[:, 0]))
        self.high, self.low, self.number = both[order, 0], both[order, 1], order
        runs = np.unique(self.high, return_counts=True)[1]
        self.most = int(runs.max(initial=0))  # words that share the first half of a digest: 1, but for chance

    def find(self, words: list[str], exact: bool) -> np.ndarray:
        """The number of each word, -1 if unknown."""
        out = np.full(len(words), -1, np.int64)
        if not words or not len(self.high):
            return out
        both = np.frombuffer(b"".join(digest(w, exact) for w in words), np.uint64).reshape(-1, 2)
        first = np.searchsorted(self.high, both[:, 0])
        for step in range(self.most):
            place = np.minimum(first + step, len(self.high) - 1)
            same = (self.high[place] == both[:, 0]) & (self.low[place] == both[:, 1])
            out[same] = self.number[place[same]]
        return out


# ---------------------------------------------------------------------------------------------------------------
# Which phrases can stand in some texts at all
# ---------------------------------------------------------------------------------------------------------------


def unfolded(texts: pa.Array) -> pa.Array:
    """The one character whose small form is longer, written as that: texts with equal small forms then fold to equal texts."""
    import pyarrow.compute as pc

    return pc.replace_substring(texts, "İ", "i̇")


def end_windows(phrases: pa.Array, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Size and hash of the first (or last) characters of each phrase, of as many as the largest size that fits; 0 for empty ones."""
    sizes, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for low in range(0, len(phrases), 4096):
        read = Texts(unfolded(phrases.slice(low, 4096)))
        lengths = np.diff(read.begins) - 1
        size = np.array((0, *SIZES))[np.searchsorted(SIZES, lengths, side="right")]
        at = read.begins[:-1] + (lengths - size if last else 0)
        sizes.append(size)
        hashes.append(np.where(size > 0, Windows(read.points).at(at, size), np.uint64(0)))
    return np.concatenate(sizes), np.concatenate(hashes)


class Sieve:
    """A few bits for each of very many hashes; what is none of them mostly falls through."""

    #: Bits for one hash, at least.
    EACH = 32
    #: Parts in which the bits are made.
    BLOCKS = 64

    def __init__(self, sizes: list[int], bits: int, blocks: dict[int, bytes]):
        self.sizes, self.shift = sizes, np.uint64(64 - bits)
        empty = bytes((1 << bits) // 8 // self.BLOCKS)
        self.packed = np.frombuffer(b"".join(blocks.get(i, empty) for i in range(self.BLOCKS)), np.uint8)
        folded_bits = max(0, bits - 24)
        some = self.packed != 0 if folded_bits >= 3 else np.unpackbits(self.packed, bitorder="little").astype(bool)
        self.quick = some.reshape(-1, 1 << (folded_bits - 3 if folded_bits >= 3 else folded_bits)).any(axis=1)
        self.quick_shift = np.uint64(64 - int(len(self.quick)).bit_length() + 1)

    @staticmethod
    def probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers of which each sets a bit for a hash."""
        return hashes, _finished(hashes + np.uint64(_STEP))

    @staticmethod
    def bits(count: int) -> int:
        return max(16, (Sieve.EACH * count - 1).bit_length())

    @staticmethod
    def block(probes: np.ndarray, bits: int) -> dict[int, bytes]:
        """The parts of the bits that some probes set."""
        places = probes >> np.uint64(64 - bits)
        size = (1 << bits) // Sieve.BLOCKS
        owner, out = places // np.uint64(size), {}
        for number in np.unique(owner):
            mine = np.zeros(size, bool)
            mine[places[owner == number] % np.uint64(size)] = True
            out[int(number)] = np.packbits(mine, bitorder="little").tobytes()
        return out

    def passing(self, texts: pa.Array) -> np.ndarray:
        """The different hashes of windows in texts that do not fall through."""
        points, out = Texts(unfolded(texts)).points, [np.zeros(0, np.uint64)]
        for low in range(0, len(points), PIECE):
            windows = Windows(points[low : low + PIECE + max(self.sizes, default=1) - 1])
            for size in self.sizes:
                made = windows.every(size, PIECE)
                made = made[self.quick[made >> self.quick_shift]]
                for number in (0, 1):
                    place = self.probes(made)[number] >> self.shift
                    made = made[(self.packed[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)]
                out.append(np.unique(made))
        return np.unique(np.concatenate(out))
