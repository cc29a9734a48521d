"""Hard negatives: whole-number products of anchors with all rows by Strassen's recursion, and heaps that merge.

A component x counts as floor(256·x). Anchors are cut into blocks of a bounded size, rows into groups; every block meets
every group in a tile, which holds the block and lets the rows of the group pass in batches. The batch is multiplied
with a stripe of anchors by Strassen's seven products, dimensions padded with zeros to even sizes, all sums exact in int64.
(Sums inside the recursion may wrap; they are exact modulo 2^64, and so is a product that fits.) Where a product might
not fit, a tile counts with unbounded whole numbers instead.

A tile keeps heaps of a few entries: first of the rows of the anchor's own label, the positives; once these are known, one
for each positive, of the rows of other labels inside its window of scores. Heaps of tiles are merged by the same order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanguard.llm.rows import stored

#: Bytes of anchors in a block, rows in a group, anchors and rows that are multiplied at once, smallest side of a recursion.
BLOCK_BYTES, GROUP_ROWS, STRIPE, BATCH, LEAF = 8 << 20, 1 << 18, 256, 2048, 32
SCALE = 256
_NO_ID = np.iinfo(np.int64).max


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of whole numbers (int64 or Python integers)."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= leaf:
        return a @ np.ascontiguousarray(b.T).T if a.dtype != object else a.dot(b)
    odd = [(side % 2) for side in (rows, inner, columns)]
    if any(odd):
        a, b = np.pad(a, ((0, odd[0]), (0, odd[1]))), np.pad(b, ((0, odd[1]), (0, odd[2])))
    r, k, c = (a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2)
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * r, 2 * c), a.dtype)
    out[:r, :c], out[:r, c:] = m1 + m4 - m5 + m7, m3 + m5
    out[r:, :c], out[r:, c:] = m2 + m4, m1 - m2 + m3 + m6
    return out[:rows, :columns]


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(256·x) of every component in double precision; Python integers where int64 might not do."""
    if not vectors.size or np.abs(vectors).max() < 2.0**31:
        return np.floor(vectors * SCALE).astype(np.int64)
    # Beyond 2^53 a double is a whole number already.
    return np.frompyfunc(lambda x: math.floor(x * SCALE) if abs(x) < 2.0**53 else int(x) * SCALE, 1, 1)(vectors).astype(object)


def products(a: np.ndarray, b: np.ndarray, factor: int = 1) -> np.ndarray:
    """All inner products of the rows of two matrices of whole numbers, exact, also once multiplied by ``factor``."""
    if a.dtype == object or b.dtype == object or a.size and b.size and int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] * factor > _NO_ID:
        a, b = a.astype(object), b.astype(object)
    return strassen(a, b.T)


class Heap:
    """For each of some places the best ``most`` (score, id, row) so far; higher scores, smaller ids, smaller rows come first."""

    def __init__(self, places: int, most: int):
        self.most, self.places = most, places
        self.at, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.full, self.least = np.zeros(places, bool), np.zeros(places, object)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(at):
            return
        at, score, ids, rows = (np.concatenate(x) for x in ((self.at, at), (self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, at)) if score.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (at[i], -score[i], ids[i], rows[i])))
        at, score, ids, rows = at[order], score[order], ids[order], rows[order]
        first = np.searchsorted(at, at)
        kept = np.arange(len(at)) - first < self.most
        self.at, self.score, self.id, self.row = at[kept], score[kept], ids[kept], rows[kept]
        last = np.searchsorted(self.at, np.arange(self.places), side="right")
        self.full = last - np.searchsorted(self.at, np.arange(self.places)) == self.most
        self.least[self.full] = self.score[last[self.full] - 1]

    def may_enter(self, places: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Flags of the scores (a row of them for each place) that a heap can still take in."""
        full = self.full[places]
        flags = np.ones(score.shape, bool)
        if full.any():
            least = self.least[places[full]]
            if score.dtype != object:
                least = np.array([max(-_NO_ID, min(_NO_ID, x)) for x in least], np.int64)
            flags[full] = score[full] >= least[:, None]
        return flags


def _matrix(column: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
    taken = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return whole(taken.reshape(len(at), size))


class _Tile:
    """A block of anchors, by length of their vectors, and what has passed it so far."""

    def __init__(self, most: int, windows: bool, low: int, high: int):
        self.most, self.windows, self.low, self.high = most, windows, low, high
        self.parts: list[pa.RecordBatch] = []
        self.sides: dict[int, tuple] | None = None

    def anchors(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)

    def _ready(self) -> dict[int, tuple]:
        if self.sides is None:
            self.sides = {}
            table = pa.Table.from_batches(self.parts).combine_chunks() if self.parts else None
            if table is not None:
                vectors = table["vector"].combine_chunks()
                sizes = vectors.value_lengths().to_numpy()
                label, row = table["label"].to_numpy(), table["row"].to_numpy()
                bounds = table["bounds"].to_pylist()
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    asked = [bounds[i] or [] for i in at]
                    ranks = max(map(len, asked), default=0) if self.windows else 1
                    heaps = [Heap(len(at), self.most) for _ in range(ranks)]
                    self.sides[size] = (_matrix(vectors, at, size), label[at], row[at], asked, heaps)
        return self.sides

    def rows(self, batch: pa.RecordBatch) -> None:
        vectors = batch.column(batch.schema.get_field_index("vector"))
        sizes = vectors.value_lengths().to_numpy()
        label, row, ids = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("label", "row", "id"))
        for size, (mine, own_label, own_row, asked, heaps) in self._ready().items():
            here = np.flatnonzero(sizes == size)
            for low in range(0, len(here), BATCH):
                at = here[low : low + BATCH]
                theirs = _matrix(vectors, at, size)
                if self.windows:
                    for first in range(0, len(mine), STRIPE):
                        self._other(np.arange(first, min(first + STRIPE, len(mine))), mine, own_label, asked, heaps, theirs, label[at], ids[at], row[at])
                    continue
                for value in np.intersect1d(own_label, label[at]).tolist():  # positives: only what shares a label is multiplied
                    us, them = np.flatnonzero(own_label == value), np.flatnonzero(label[at] == value)
                    for first in range(0, len(us), STRIPE):
                        part = us[first : first + STRIPE]
                        score = products(mine[part], theirs[them])
                        open_ = heaps[0].may_enter(part, score) & (row[at][them][None, :] != own_row[part][:, None])
                        x, y = np.nonzero(open_)
                        heaps[0].add(part[x], score[x, y], ids[at][them[y]], row[at][them[y]])

    def _other(self, part, mine, own_label, asked, heaps, theirs, label, ids, row) -> None:
        score = products(mine[part], theirs, max(self.low, self.high))
        other = own_label[part][:, None] != label[None, :]
        for rank, heap in enumerate(heaps):
            named = np.flatnonzero([len(asked[i]) > rank for i in part])
            if not len(named):
                continue
            bound, scores = [asked[i][rank] for i in part[named]], score[named]
            if max(map(abs, bound)) * max(self.low, self.high) > _NO_ID:
                scores = scores.astype(object)
            bound = np.array(bound, scores.dtype)[:, None]
            inside = other[named] & (scores <= bound)
            inside &= self.low * bound <= self.high * scores
            inside &= heap.may_enter(part[named], scores)
            x, y = np.nonzero(inside)
            heap.add(part[named[x]], scores[x, y], ids[y], row[y])

    def found(self):
        for size, (_, _, own_row, _, heaps) in sorted(self._ready().items()):
            for rank, heap in enumerate(heaps):
                if len(heap.at):
                    score = [int(s) for s in heap.score]
                    if any(not -(1 << 63) <= s < 1 << 63 for s in score):
                        raise OverflowError("an inner product among the results does not fit a long")
                    yield pa.RecordBatch.from_pydict({"anchor": own_row[heap.at], "place": np.full(len(heap.at), rank + 1), "score": pa.array(score, pa.int64()), "id": heap.id, "row": heap.row})


_FOUND = "anchor long, place long, score long, id long, row long"


def _tiles(most: int, windows: bool, low: int, high: int):
    def run(batches):
        tile, key = None, None
        for batch in batches:
            block, group, passing = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("block", "group", "passing"))
            change = (np.diff(block) != 0) | (np.diff(group) != 0) | (np.diff(passing) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                if key != (here := (block[begin], group[begin])):
                    if tile is not None:
                        yield from tile.found()
                    tile, key = _Tile(most, windows, low, high), here
                (tile.rows if passing[begin] else tile.anchors)(batch.slice(begin, end - begin))
        if tile is not None:
            yield from tile.found()

    return run


def _searched(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, most: int, windows: bool, low: int = 0, high: int = 0) -> DataFrame:
    """The best of each tile: blocks of anchors sent to every group, groups of rows to every block, as rows of one table."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["block", "group", "passing", "row", "id", "label", "vector", "bounds"]
    mine = anchors.withColumn("group", every(groups)).withColumn("passing", F.lit(0)).select(columns)
    theirs = rows.withColumn("block", every(blocks)).withColumn("passing", F.lit(1)).withColumn("bounds", F.lit(None).cast("array<long>")).select(columns)
    dealt = mine.union(theirs).repartition("block", "group").sortWithinPartitions("block", "group", "passing")
    return dealt.mapInArrow(_tiles(most, windows, low, high), _FOUND)


def _best(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """Merges the heaps of tiles; each task sends on ``most`` rows a place at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _spread(column: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    label: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every row where ``anchor`` holds.

    A score is the whole-number inner product with the anchor; higher ones come first, ties by smaller key. An anchor's
    positives are its first ``positives`` other rows of its label; for each of these, the first ``negatives`` rows of other
    labels with ``low`` · positive score <= ``high`` · negative score <= ``high`` · positive score are returned, as many as there are.

    Rows with a null label or vector, or a null or non-finite component, take no part. ``anchor`` and ``label`` are computed on
    ``df``; a null ``anchor`` is none. Rows are told apart by where they are, not by their key: rows with one key are rows
    like others, each an anchor if its key says so; a null key comes last among ties. Vectors of different lengths do not
    meet; empty ones have score 0 with each other. An empty table gives none; further columns are not read.
    """
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = df.select(F.col(key).cast("long").alias("id"), label.cast("string").alias("name"), F.col(vector).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asked"))
    usable = given.where(F.col("name").isNotNull() & F.col("vector").isNotNull() & finite)
    # Labels are compared by 64 bits of a hash; the row's number is its place in the table as written here.
    kind = usable.select(F.coalesce("id", F.lit(_NO_ID)).alias("id"), F.xxhash64("name").alias("label"), "vector", "asked")
    rows = stored(kind.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, asked, longest = rows.agg(F.count("*"), F.count_if("asked"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-asked * max(1, longest) * 8 // BLOCK_BYTES))
    # Groups: so many that tiles fill the cluster, and none is so large that losing its task costs much.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n // GROUP_ROWS), min(-(-2 * cores // blocks), -(-n // BATCH)))
    rows = rows.withColumn("group", _spread(F.col("row"), groups))
    anchors = rows.where("asked").withColumn("block", _spread(F.col("row"), blocks)).withColumn("bounds", F.lit(None).cast("array<long>"))
    near = _best(_searched(anchors, rows, blocks, groups, positives, False), ["anchor"], positives)
    near = stored(near.select("anchor", "rank", "score", "id"), "positives")
    bounds = near.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("bounds"))
    known = anchors.drop("bounds").join(bounds, "row")
    far = _best(_searched(known, rows, blocks, groups, negatives, True, low, high), ["anchor", "place"], negatives)
    named = near.select("anchor", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    pairs = far.select("anchor", "place", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score")).join(named, ["anchor", "place"])
    ids = rows.where("asked").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_key"))
    unnamed = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
    return pairs.join(ids, "anchor").select(
        unnamed("anchor_key").alias("anchor_id"),
        unnamed("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        unnamed("negative").alias("negative_id"),
        "positive_score",
        "negative_score",
    )
