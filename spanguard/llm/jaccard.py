"""N-gram Jaccard join of all texts: T-occurrence search with DivideSkip, in blocks that every link shares.

Sets. A text's set holds a 64-bit hash for each distinct shingle of ``width`` words. Texts with one set are one node; a node
is named by a 64-bit hash of its set.

Blocks. Two linked sets of sizes s ≤ t differ in few elements, at most k for all sets of a class of sizes. Hash space is cut
into more than k ranges, so in some range both have the same elements; a node sends a key for each range that is not empty
(with spare ranges; a node with more empty ranges than spares sends keys for these too). Nodes that share a key are joined
into candidate groups by their names alone. A shared passage does not make a group, as whole ranges have to agree.

Refinement. Each node has a bitmap in which every element flips one bit: two bitmaps differ in at most as many bits as their
sets differ in elements. Pairs of a group whose bitmaps differ in more bits than a link allows cannot link; the groups that
the other pairs form are the ones searched.

Tiles. Only sets of like size can link, so a group is cut into bands of two neighbouring classes of sizes, and a large band
into blocks, each two of which share a tile of bounded size.

Search. In a tile an inverted list for each shingle holds the nodes in order of size. For each node its longest lists are set aside, the
short ones are merged with a heap that skips (MergeSkip), and nodes that occur often enough there are probed in the long
lists by binary search. Links are decided by whole numbers: (100 + least) · overlap ≥ least · (s + t).
"""

from __future__ import annotations

import math
from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanguard.llm.bytetext import NOT_SPACE, Hasher, mixed, slices, words
from spanguard.llm.graph import components
from spanguard.llm.rows import stored
from spanguard.llm.vectors import least_labels
from spanguard.llm.worker import kept

#: A group is cut into blocks of so many nodes, but not into more than so many blocks, until a block holds so many nodes or
#: elements (about); then blocks become more.
LEAST_BLOCK, FEW_BLOCKS, MOST_BLOCK, MOST_ELEMENTS = 64, 6, 2048, 1 << 18
#: Bits of a bitmap at least; larger sets have two for each element.
BITMAP_BITS = 1024
#: Bits of the filter of candidate names: 16 for each name, this many at most (beyond it lets more pass, which a join drops).
MOST_FILTER_BITS = 1 << 27
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(column, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer words, the hash of the whole sequence; of none, an empty set."""
    hashes, bounds = words(column, NOT_SPACE, kept("hasher", Hasher))
    n = np.diff(bounds)
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for step in range(width):
        rolled = rolled * _ODD[0] + mixed(hashes[step : step + len(rolled)] + _ODD[1 + step % 4])
    rolled = mixed(rolled)
    out = []
    for low, count in zip(bounds.tolist(), n.tolist()):
        if count >= width:
            out.append(np.unique(rolled[low : low + count - width + 1]))
        elif count:
            value = np.array([count], np.uint64)
            for place in range(low, low + count):
                value = mixed(value * _ODD[2] + hashes[place : place + 1]) ^ _ODD[3]
            out.append(value)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_name(elements: np.ndarray) -> int:
    total = np.add.reduce(mixed(elements * _ODD[1]), keepdims=True) + np.array([len(elements)], np.uint64) * _ODD[4]
    return int(mixed(total).view(np.int64)[0])


def bitmap(elements: np.ndarray) -> bytes:
    """A bit for each value of some bits of the elements' hashes: set if an odd number of elements has it."""
    bits = max(BITMAP_BITS, 1 << (2 * len(elements) - 1).bit_length())
    odd = np.bincount((mixed(elements + _ODD[3]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all of the length of the shortest: the parity of fewer hash bits."""
    words_of = [np.frombuffer(m, np.uint64) for m in maps]
    width = min(map(len, words_of))
    return np.stack([np.bitwise_xor.reduce(w.reshape(-1, width), axis=0) for w in words_of])


def size_classes(most: int, least: int) -> list[int]:
    """First sizes of classes: a set and any linked larger set lie in one class or in neighbouring ones."""
    firsts = [1]
    while firsts[-1] <= most:
        firsts.append(100 * firsts[-1] // least + 1)
    return firsts


def class_parts(first: int, after: int, least: int) -> tuple[int, int]:
    """For pairs whose smaller set lies in a class: ranges, and how many of them may be empty in both. (0, 0): no differing pair links.

    Spare ranges are a fiftieth, or three deviations more than a set of the class has empty on average, where that does not
    make ranges much smaller (they hold the fewer elements, the less they tell apart).
    """
    s = after - 1
    differ = (s + 100 * s // least) * (100 - least) // (100 + least)
    if not differ:
        return 0, 0
    empty = (differ + 1) * math.exp(-first / (differ + 1))
    spare = max(differ // 50 + 1, min(differ // 8 + 1, math.ceil(empty + 3 * math.sqrt(empty))))
    return differ + 1 + spare, spare


def keys_of(elements: np.ndarray, firsts: list[int], least: int) -> np.ndarray:
    """The keys of a set, for its own class of sizes and for the one below."""
    own = int(np.searchsorted(firsts, len(elements), side="right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(elements ^ _ODD[2]))])
    out = []
    for number in (own - 1, own):
        if number < 0:
            continue
        parts, spare = kept(("parts", number, least), lambda: class_parts(firsts[number], firsts[number + 1], least))
        if not parts:
            continue
        edges = kept(("ranges", parts), lambda: np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64))
        at = np.concatenate([[0], np.searchsorted(elements, edges), [len(elements)]])
        full = np.diff(at) > 0
        keys = mixed(sums[at[1:]] - sums[at[:-1]] + mixed(np.arange(parts, dtype=np.uint64) + np.uint64(number << 32)))
        out.append(keys[full] if parts - np.count_nonzero(full) <= spare else keys)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _named(key: str, text: str, width: int):
    def run(batches):
        for batch in slices(batches, text):
            sets = shingle_sets(batch.column(batch.schema.get_field_index(text)), width)
            names = pa.array([set_name(s) if len(s) else None for s in sets], pa.int64())
            columns = [batch.column(batch.schema.get_field_index(key)), pa.array([len(s) for s in sets], pa.int64()), names, pa.array(map(bitmap, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_shingles", "node", "bitmap"])

    return run


def _keyed(text: str, width: int, least: int):
    def run(batches):
        seen: set[int] = set()  # names of this task's texts: copies send their keys once
        firsts = size_classes(1 << 40, least)
        for batch in slices(batches, text):
            keys, names, sizes = [], [], []
            for elements in shingle_sets(batch.column(batch.schema.get_field_index(text)), width):
                if not len(elements) or (name := set_name(elements)) in seen:
                    continue
                seen.add(name)
                keys.append(keys_of(elements, firsts, least))
                names.append(name)
                sizes.append(len(keys[-1]))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(names, np.int64), sizes))], names=["key", "node"])

    return run


def _places(names: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mixed(names.view(np.uint64) ^ odd) & np.uint64(bits - 1)) for odd in _ODD[:3]]


def _marks(bits: int):
    def run(batches):
        for batch in batches:
            places = np.concatenate(_places(batch.column(0).to_numpy().astype(np.int64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(5)).astype(np.int64)), pa.array((np.int64(1) << (places & np.uint64(31)).astype(np.int64)))], names=["word", "mask"])

    return run


def name_filter(members: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of names with a bounded number of bits: which texts can be members at all."""
    n = members.count()
    bits = min(MOST_FILTER_BITS, 1 << max(10, (16 * n).bit_length()))
    found = members.select("node").mapInArrow(_marks(bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits >> 5, np.uint32)
    table[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return bits, table


def _fetched(text: str, width: int, shared):
    def run(batches):
        seen: set[int] = set()
        bits, table = shared.value
        for batch in slices(batches, text):
            sets = [s for s in shingle_sets(batch.column(batch.schema.get_field_index(text)), width) if len(s)]
            names = np.array([set_name(s) for s in sets], np.int64)
            ok = np.ones(len(names), bool)
            for place in _places(names, bits):
                ok &= (table[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0
            take = []
            for row in np.flatnonzero(ok).tolist():
                if int(names[row]) not in seen:
                    seen.add(int(names[row]))
                    take.append(row)
            for low in range(0, len(take), 256):
                part = take[low : low + 256]
                yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array([sets[r].tobytes() for r in part], pa.binary())], names=["node", "payload"])

    return run


def merge_skip(lists: list[list[int]], need: int):
    """Numbers that occur in at least ``need`` of the sorted lists, with the lists they occur in: a heap of heads, skipping."""
    at = [0] * len(lists)
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapify(heap)
    while len(heap) >= need:
        value, popped = heap[0][0], []
        while heap and heap[0][0] == value:
            popped.append(heappop(heap)[1])
        if len(popped) >= need:
            yield value, len(popped)
            for k in popped:
                at[k] += 1
                if at[k] < len(lists[k]):
                    heappush(heap, (lists[k][at[k]], k))
            continue
        while len(popped) < need - 1 and heap:
            popped.append(heappop(heap)[1])
        if not heap:
            return
        following = heap[0][0]
        for k in popped:  # nothing below the next head can occur often enough
            at[k] = bisect_left(lists[k], following, at[k])
            if at[k] < len(lists[k]):
                heappush(heap, (lists[k][at[k]], k))


class Groups:
    """Union-find over the rows of a tile."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def divide_skip(sets: list[np.ndarray], sides: list[int] | None, least: int) -> list[tuple[int, int]]:
    """Links between rows of a tile that join all rows connected by links; with sides, between rows of different sides only.

    ``sets`` are in ascending order of size. Pairs that earlier links connect already are not decided again.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(n), sizes)
    order = np.argsort(tokens, kind="stable")
    listed, counts = rows[order], np.bincount(tokens)
    begins = np.concatenate([[0], np.cumsum(counts)])
    entries = tokens[order].astype(np.int64) * n + listed  # sorted: the whole index, for binary probes
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    shared = np.add.reduceat((counts[tokens] > 1).astype(np.int64), offsets[:-1])
    groups, links = Groups(n), []
    for x in range(n - 1):
        s = int(sizes[x])
        wanted = -(-2 * s * least // (100 + least))  # of a partner of the same size; larger ones need more
        if shared[x] < wanted:
            continue
        last = int(np.searchsorted(sizes, 100 * s // least, side="right"))
        own = tokens[offsets[x] : offsets[x + 1]]
        by_length = own[np.argsort(counts[own], kind="stable")]
        longest = int(counts[by_length[-1]])
        aside = min(wanted - 1, int(wanted / (0.01 * math.log2(longest) + 1)))
        short, long = by_length[: s - aside], by_length[s - aside :]
        lists = []
        for token in short[counts[short] > 1].tolist():
            whole = listed[begins[token] : begins[token + 1]]
            lists.append(whole[np.searchsorted(whole, x, side="right") : np.searchsorted(whole, last)].tolist())
        found = [(y, c) for y, c in merge_skip([z for z in lists if z], wanted - aside) if sides is None or sides[y] != sides[x]]
        root = groups.root(x)
        found = [(y, c) for y, c in found if groups.root(y) != root]
        if not found:
            continue
        ys = np.array([y for y, _ in found])
        overlap = np.array([c for _, c in found])
        probes = (long.astype(np.int64)[:, None] * n + ys[None, :]).ravel()
        place = np.minimum(np.searchsorted(entries, probes), len(entries) - 1)
        overlap = overlap + (entries[place] == probes).reshape(len(long), len(ys)).sum(0)
        for y in ys[(100 + least) * overlap >= least * (s + sizes[ys])].tolist():
            if groups.root(y) != groups.root(x):
                groups.up[groups.root(y)] = groups.root(x)
                links.append((x, y))
    return links


def possible_pairs(maps: np.ndarray, sizes: np.ndarray, other_maps: np.ndarray, other_sizes: np.ndarray, least: int):
    """Index pairs whose bitmaps (rows of 64-bit words) differ in no more bits than a link of such sizes allows."""
    for low in range(0, len(maps), 64):
        part, own = maps[low : low + 64], sizes[low : low + 64, None]
        both = own + other_sizes[None, :]
        differ = np.zeros(both.shape, np.int64)
        for word in range(maps.shape[1]):
            differ += np.bitwise_count(part[:, word, None] ^ other_maps[None, :, word])
        x, y = np.nonzero(differ * (100 + least) <= both * (100 - least))
        yield x + low, y


def _blocks(rows):
    """The nodes of a tile: names, sizes, payloads and the block of each."""
    names, sizes, payloads, blocks = [], [], [], []
    for block, members in rows:
        for member in members:
            names.append(member["node"])
            sizes.append(member["n"])
            payloads.append(member["payload"])
            blocks.append(block)
    return names, sizes, payloads, blocks


def _refined_tile(rows, first: int, second: int, least: int):
    """Node and least node of its group of possible links, for nodes with one."""
    names, sizes, payloads, blocks = _blocks(rows)
    names, sizes, blocks = np.array(names, np.int64), np.array(sizes, np.int64), np.array(blocks)
    maps = folded(payloads)
    a, b = np.flatnonzero(blocks == first), np.flatnonzero(blocks == second)
    ranks = np.argsort(np.argsort(names))
    found = [(a[x], b[y]) for x, y in possible_pairs(maps[a], sizes[a], maps[b], sizes[b], least)]
    x, y = (np.concatenate(z) if found else np.zeros(0, np.int64) for z in (list(zip(*found)) or [[], []]))
    keep = x != y
    labels = least_labels(ranks.copy(), x[keep], y[keep])
    moved = np.flatnonzero(labels != ranks)
    return names[moved], np.sort(names)[labels[moved]]


def _searched_tile(rows, first: int, second: int, least: int):
    """Links that join all nodes of a tile connected by links."""
    names, sizes, payloads, blocks = _blocks(rows)
    order = sorted(range(len(names)), key=lambda i: (sizes[i], names[i]))
    sets = [np.frombuffer(payloads[i], np.uint64) for i in order]
    links = divide_skip(sets, None if first == second else [blocks[i] for i in order], least) if len(sets) > 1 else []
    return [names[order[x]] for x, _ in links], [names[order[y]] for _, y in links]


def _tiles(work, least: int):
    """Runs ``work`` on each tile; the rows of a tile (one for each of its blocks) come after each other."""

    def run(batches):
        tile, rows = None, []

        def done():
            a, b = work(rows, *tile[2:], least)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("component", "band", "i", "j", "block", "members")]
            for row in range(batch.num_rows):
                component, band, i, j, block, members = (c[row].as_py() for c in columns)
                if (component, band, i, j) != tile:
                    if tile:
                        yield done()
                    tile, rows = (component, band, i, j), []
                rows.append((block, members))
        if tile:
            yield done()

    return run


def _met(members: DataFrame, work, least: int) -> DataFrame:
    """Edges ``a, b`` that ``work`` finds in the tiles of each band; members: node, component, band, n, blocks, payload."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.withColumn("block", block).repartition("component", "band", "block")  # or a large component would be packed by one task
    packed = dealt.groupBy("component", "band", "blocks", "block").agg(F.collect_list(F.struct("node", "n", "payload")).alias("members"))
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = met.select("component", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "members")
    place = ["component", "band", "i", "j"]
    return tiles.repartition(*place).sortWithinPartitions(*place).mapInArrow(_tiles(work, least), "a long, b long")


def _grouped(edges: DataFrame, names: DataFrame, least: int, by_elements: bool) -> DataFrame:
    """Nodes of edges with their component, the two bands of sizes they belong to, and the number of blocks of each band.

    A component of no more nodes than a block is one band. Classes are a little wider than the ratio of linked sizes, so
    rounding cannot part two linked sets by two classes.
    """
    sized = stored(components(edges, "a", "b").join(names, "node"), "groups")
    counts = sized.groupBy("component").agg((F.count("*") <= LEAST_BLOCK).alias("small"))
    size_class = F.floor(F.log(F.col("n")) / (math.log(100 / least) * 1.0001)).cast("int")
    of_class = F.when(F.col("small"), F.array(F.lit(0))).otherwise(F.array(F.col("class") - 1, F.col("class")))
    banded = sized.join(counts, "component").withColumn("class", size_class).withColumn("band", F.explode(of_class))
    low = F.min(F.when(F.col("small"), F.col("band")).otherwise(F.col("class")))
    totals = banded.groupBy("component", "band").agg(F.count("*").alias("nodes"), F.sum("n").alias("elements"), low.alias("low"))
    # A band with sets of its upper class only has nothing to find that the next band does not find.
    totals = totals.where((F.col("nodes") > 1) & (F.col("low") == F.col("band")))
    few = F.least(F.ceil(F.col("nodes") / LEAST_BLOCK), F.lit(FEW_BLOCKS))
    bounds = [F.ceil(F.col("nodes") / MOST_BLOCK)] + ([F.ceil(F.col("elements") / MOST_ELEMENTS)] if by_elements else [])
    blocks = totals.select("component", "band", F.greatest(few, *bounds).cast("int").alias("blocks"))
    return banded.drop("class", "small").join(blocks, ["component", "band"])


def joined(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: int = 80) -> DataFrame:
    """``key, n_shingles, component_id`` for every row: sets link whose Jaccard similarity is ``least`` hundredths or more.

    ``component_id`` is the smallest key reachable by links, the row's own included; null and blank texts have no shingles
    and are components of their own. A null key names no component: it is null where no linked row has a key. Repeated rows
    are copies like others. Equal and similar texts are never expanded into all pairs.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    docs = stored(source.mapInArrow(_named("key", "text", width), f"key {dict(df.dtypes)[key]}, n_shingles long, node long, bitmap binary"), "sets")
    keys = source.select("text").mapInArrow(_keyed("text", width, least), "key long, node long")
    first = F.first("node").over(Window.partitionBy("key").orderBy("node"))
    pairs = keys.withColumn("a", first).where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct()
    names = docs.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("key").alias("least_key"), F.min("n_shingles").alias("n"), F.min("bitmap").alias("bitmap"))
    names = stored(names, "names")
    candidates = _grouped(pairs, names.select("node", "n", F.col("bitmap").alias("payload")), least, False)
    possible = _met(candidates, _refined_tile, least)
    members = stored(_grouped(possible, names.select("node", "n"), least, True), "members")
    shared = df.sparkSession.sparkContext.broadcast(name_filter(members.select("node").distinct()))
    sets = source.select("text").mapInArrow(_fetched("text", width, shared), "node long, payload binary")
    links = _met(sets.join(members, "node").dropDuplicates(["node", "band"]), _searched_tile, least)
    groups = components(links, "a", "b")
    labelled = names.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = labelled.groupBy("component").agg(F.min("least_key").alias("component_id"))
    found = stored(labelled.join(labels, "component").select("node", "component_id"), "labels")
    out = docs.join(found, "node", "left")
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
