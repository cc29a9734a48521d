"""Benchmark decontamination: a generalised suffix automaton of normalised test items, streamed over by training words.

Words are folded to small letters. A window is ``length`` consecutive words of an item, or the whole of a shorter one. The
automaton of all items tracks the longest match that ends at each word of a text; from it follow the windows that occur,
the words they cover and the items they belong to.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanguard.llm.bytetext import ALPHANUMERIC, Hasher, cuts, run_bounds, slices, text_bytes, words
from spanguard.llm.worker import kept

#: Bytes of item texts in one automaton, which is broadcast; more items make more automata, applied one after the other.
#: Random words of six letters, 4 MB: 0.31 GB at most while it was built on the driver, then 0.09 GB, 32 MB of it broadcast.
SHARD_BYTES = 4 << 20
_RUN = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


class Automaton:
    """Suffix automaton of distinct sequences of word numbers, with the numbers of those below each state.

    Built with a dictionary for each state, then kept as flat arrays: 8 bytes a state and 16 a transition.
    """

    def __init__(self, sequences: list[tuple[int, ...]], length: int):
        self.length, self.next, self.link, self.size = length, [{}], [-1], [0]
        self.words = 1 + max((max(s) for s in sequences if s), default=0)
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extended(last, word)
        self._freeze()
        self._label(sequences)

    def _clone(self, state: int, size: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.size.append(size)
        self.link[state] = len(self.size) - 1
        return self.link[state]

    def _redirect(self, state: int, word: int, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]

    def _extended(self, last: int, word: int) -> int:
        """The state of the longer prefix; an existing transition is used, split where its state holds longer words too."""
        there = self.next[last].get(word)
        if there is not None:
            if self.size[there] == self.size[last] + 1:
                return there
            copy = self._clone(there, self.size[last] + 1)
            self._redirect(last, word, there, copy)
            return copy
        new, state = len(self.size), last
        self.next.append({})
        self.link.append(0)
        self.size.append(self.size[last] + 1)
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            there = self.next[state][word]
            if self.size[there] == self.size[state] + 1:
                self.link[new] = there
            else:
                copy = self._clone(there, self.size[state] + 1)
                self._redirect(state, word, there, copy)
                self.link[new] = copy
        return new

    def _freeze(self) -> None:
        """Transitions as sorted keys (state, word) with their targets."""
        self.link, self.size = array("i", self.link), array("i", self.size)
        keys = np.fromiter((state * self.words + word for state, there in enumerate(self.next) for word in there), np.int64)
        targets = np.fromiter((target for there in self.next for target in there.values()), np.int32, len(keys))
        order = np.argsort(keys)
        self.keys, self.targets = array("q", keys[order].tobytes()), array("i", targets[order].tobytes())
        self.next = None

    def _there(self, state: int, word: int) -> int:
        key = state * self.words + word
        place = bisect_left(self.keys, key)
        return self.targets[place] if place < len(self.keys) and self.keys[place] == key else -1

    def _label(self, sequences) -> None:
        """Sequences of each window state; short ones at the state of their whole, with links to the next such state below."""
        sizes = np.asarray(self.size)
        order = np.argsort(sizes, kind="stable").tolist()
        self.anchor = array("i", [-1]) * len(order)
        below: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for state in order[1:]:
            up = self.link[state]
            if self.size[state] >= self.length:
                self.anchor[state] = state if self.size[up] < self.length else self.anchor[up]
        for number, sequence in enumerate(sequences):
            if 0 < len(sequence) < self.length:
                state = 0
                for word in sequence:
                    state = self._there(state, word)
                self.short.setdefault(state, []).append((len(sequence), number))
            else:
                for state, size, _ in self.walk(sequence):
                    if size >= self.length:
                        below.setdefault(self.anchor[state], set()).add(number)
        self.long = {state: tuple(numbers) for state, numbers in below.items()}
        self.output = array("i", [-1]) * len(order)  # nearest state on the way down the links, itself included, with short ones
        if self.short:
            for state in order[1:]:
                self.output[state] = state if state in self.short else self.output[self.link[state]]

    def walk(self, sequence):
        """State and length of the longest match that ends at each word."""
        state = size = 0
        for place, word in enumerate(sequence):
            while (there := self._there(state, word)) < 0 and state:
                state = self.link[state]
                size = self.size[state]
            if there >= 0:
                state, size = there, size + 1
            yield state, size, place

    def hits(self, sequence) -> tuple[list[tuple[int, int]], set[int]]:
        """Covered stretches of words, and the numbers of the sequences whose windows occur."""
        covered, numbers = [], set()
        for state, size, place in self.walk(sequence):
            reach = 0
            if size >= self.length:
                reach = self.length
                numbers.update(self.long.get(self.anchor[state], ()))
            end = self.output[state]
            while end > 0:
                for short, number in self.short[end]:
                    if short <= size:
                        reach = max(reach, short)
                        numbers.add(number)
                end = self.output[self.link[end]]
            if reach:
                start = place + 1 - reach
                while covered and covered[-1][1] >= start:
                    start = min(start, covered.pop()[0])
                covered.append((start, place + 1))
        return covered, numbers


class Index:
    """What a task needs: vocabulary and pairs of neighbouring words as sorted hashes, and the automaton."""

    def __init__(self, items: list[tuple[str, str]], length: int):
        hasher = Hasher()
        hashes, bounds = words(pa.array([text for _, text in items], pa.string()), ALPHANUMERIC, hasher)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        sequences = [numbers[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        self.shortest = min([length, *(len(s) for s in sequences if s)])
        pairs = {a * len(self.vocabulary) + b for s in sequences for a, b in zip(s, s[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        named: dict[tuple[int, ...], set[str]] = {}
        for (name, _), sequence in zip(items, sequences):
            if sequence:
                named.setdefault(tuple(sequence), set()).add(name)
        self.names = [tuple(sorted(names)) for names in named.values()]  # equal items are one sequence
        self.automaton = Automaton(list(named), length)

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == hashes, place, -1)

    def stretches(self, numbers: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Maximal stretches inside one text all of whose neighbours are neighbours in an item too, long enough for a window."""
        inside = numbers >= 0
        joined = np.zeros(len(numbers) + 1, bool)  # word i goes on from word i-1
        if len(numbers) > 1 and len(self.pairs):
            both = np.flatnonzero(inside[1:] & inside[:-1])
            pair = numbers[both] * len(self.vocabulary) + numbers[both + 1]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[both[self.pairs[place] == pair] + 1] = True
        joined[bounds] = False
        starts = np.flatnonzero(inside & ~joined[:-1])
        ends = np.flatnonzero(inside & ~joined[1:]) + 1
        long = ends - starts >= self.shortest
        return list(zip(starts[long].tolist(), ends[long].tolist()))


def word_bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the words of one text."""
    raw, bounds = text_bytes(pa.array([text], pa.string()))
    starts, ends = [], []
    edges = cuts(raw, ALPHANUMERIC, bounds)
    for low, high in zip(edges, edges[1:]):
        a, b = run_bounds(raw[low:high], np.zeros(0, np.int64), ALPHANUMERIC)
        starts.append(a + low)
        ends.append(b + low)
    return np.concatenate(starts), np.concatenate(ends)


def _pass(index, text: str, earlier: bool):
    """One pass over batches: number of words, covered runs (word numbers and bytes) and items, added to earlier ones."""

    def run(batches):
        own = index.value
        hasher = kept("hasher", Hasher)
        for batch in slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            hashes, bounds = words(column, ALPHANUMERIC, hasher)
            numbers = own.numbered(hashes)
            rows: dict[int, tuple[list, set]] = {}
            for a, b in own.stretches(numbers, bounds):
                covered, known = own.automaton.hits(numbers[a:b].tolist())
                if covered:
                    row = int(np.searchsorted(bounds, a, side="right")) - 1
                    runs, seen = rows.setdefault(row, ([], set()))
                    runs += [(x + a - int(bounds[row]), y + a - int(bounds[row])) for x, y in covered]
                    seen |= known
            runs = batch.column(batch.schema.get_field_index("__runs")).to_pylist() if earlier else [[]] * batch.num_rows
            items = batch.column(batch.schema.get_field_index("__items")).to_pylist() if earlier else [[]] * batch.num_rows
            runs, items = list(runs), list(items)
            for row, (new, known) in rows.items():
                starts, ends = word_bytes(column[row].as_py())
                merged: list[list[int]] = []
                for x, y in sorted([(r["first"], r["after"]) for r in runs[row]] + new):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(y, merged[-1][1])
                    else:
                        merged.append([x, y])
                runs[row] = [{"first": x, "after": y, "start": int(starts[x]), "end": int(ends[y - 1])} for x, y in merged]
                items[row] = sorted({*items[row], *(name for number in known for name in own.names[number])})
            keep = [n for n in batch.schema.names if n not in ("__words", "__runs", "__items")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in keep), pa.array(np.diff(bounds)), pa.array(runs, _RUN), pa.array(items, pa.list_(pa.string()))],
                names=[*keep, "__words", "__runs", "__items"],
            )

    return run


def matched(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = 10) -> DataFrame:
    """Adds ``__words`` (their number), ``__runs`` (covered stretches: first word, word after, bytes) and ``__items``.

    Null and empty texts have no words; items without words have no windows, an item whose id is null is named by an empty
    string; repeated items count once. One narrow pass for each automaton: no shuffle.
    """
    spark = df.sparkSession
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = named.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    shards = max(1, -(-2 * total // SHARD_BYTES)) if total > SHARD_BYTES else 1
    names = df.columns
    out = df
    for shard in range(shards):
        part = named.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == shard)
        rows, size = [], 0
        for row in part.toLocalIterator():  # bounded: a share of the items of SHARD_BYTES at most, checked here
            size += len(row["text"]) + 32
            if size > 4 * SHARD_BYTES:
                raise ValueError("one test item is larger than an automaton may be")
            rows.append((row["id"], row["text"]))
        index = spark.sparkContext.broadcast(Index(sorted(set(rows)), length))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        schema = f"{kinds}, __words long, __runs array<struct<first:long,after:long,start:long,end:long>>, __items array<string>"
        out = out.mapInArrow(_pass(index, text, shard > 0), schema)
    return out.select(*names, "__words", "__runs", "__items")


def covered_words() -> Column:
    return F.aggregate("__runs", F.lit(0).cast("long"), lambda total, run: total + run["after"] - run["first"])


def decontaminated(df: DataFrame, items: DataFrame, text: str = "text", length: int = 10, most_share: float = 0.5, **names) -> DataFrame:
    """Cuts covered stretches of any length and number out of the texts; drops a text only if more than ``most_share`` of its words are covered.

    Texts without a hit (null and empty ones too) stay as they are.
    """
    found = matched(df, items, text, length=length, **names)
    hit, total = covered_words(), F.col("__words")
    raw = F.col(text).cast("binary")
    size = F.octet_length(text).cast("long")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("__runs", lambda run: run["end"]))
    ends = F.concat(F.transform("__runs", lambda run: run["start"]), F.array(size))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")).cast("string"))
    clean = F.when(F.size("__runs") > 0, F.array_join(pieces, "")).otherwise(F.col(text))
    return found.where(hit <= total * most_share).withColumn(text, clean).select(*df.columns)
