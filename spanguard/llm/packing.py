"""Packing along a space-filling curve: neighbours in topic become neighbours in a sequence.

A document's vector is the sum of hashed signs of its token ids, projected to three dimensions. Projections are scaled by
their mean and deviation over all documents and placed on a Hilbert curve; documents sorted by their place on it form one
stream of ids, cut every ``length`` ids. Only the last sequence of all is shorter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from spanguard.llm import tokens
from spanguard.llm.bytetext import mixed, slices
from spanguard.llm.rows import numbered, stored
from spanguard.llm.worker import kept

DIMENSIONS, BITS = 3, 16


def _directions() -> np.ndarray:
    """A direction for each hashed id: what a sparse sign projection of hashed counts adds for it."""
    ids = np.arange(1 << 16, dtype=np.uint64)
    return np.stack([(mixed(ids * np.uint64(3) + np.uint64(d)) & np.uint64(0xFFFF)).astype(np.float32) / 32767.5 - 1 for d in range(DIMENSIONS)])


def projected(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean direction of the ids of each document (none: the origin)."""
    low = (ids & 0xFFFF).astype(np.int64)
    out = np.zeros((len(bounds) - 1, DIMENSIONS))
    for d, direction in enumerate(kept("directions", _directions)):
        sums = np.concatenate([[0.0], np.cumsum(direction[low], dtype=np.float64)])
        out[:, d] = sums[bounds[1:]] - sums[bounds[:-1]]
    return out / np.maximum(1, np.diff(bounds))[:, None]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the curve of points with ``bits``-bit coordinates (rows): axes to transposed index, then bits interleaved."""
    x = [c.astype(np.uint64) for c in cells.T]
    n, one = len(x), np.uint64(1)
    level = np.uint64(1 << (bits - 1))
    while level > one:
        low = level - one
        for i in range(n):
            high = (x[i] & level) != 0
            swap = np.where(high, low, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ swap
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        level >>= one
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    fold, level = np.zeros(len(cells), np.uint64), np.uint64(1 << (bits - 1))
    while level > one:
        fold = np.where((x[n - 1] & level) != 0, fold ^ (level - one), fold)
        level >>= one
    x = [c ^ fold for c in x]
    key = np.zeros(len(cells), np.uint64)
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = (key << one) | ((c >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def curve_place(vectors: list[Column], centre: list[float], spread: list[float]) -> Column:
    """Hilbert place of scaled vectors; three deviations on either side fill the cube, what lies beyond goes to its faces."""

    @F.arrow_udf("long")
    def place(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        points = np.stack([x.to_numpy(zero_copy_only=False) for x in (a, b, c)], 1)
        scaled = (points - np.array(centre)) / (6 * np.array(spread)) + 0.5
        return pa.array(hilbert((np.clip(scaled, 0, 1) * ((1 << BITS) - 1)).astype(np.int64)))

    return place(*vectors)


def _encoded(key: str, text: str, tokenizer: str):
    def run(batches):
        import zstandard

        squeeze, part, row = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        for batch in slices(batches, text):
            ids, bounds = tokens.encoder(tokenizer).encode(batch.column(batch.schema.get_field_index(text)))
            vectors, n = projected(ids, bounds), batch.num_rows
            blobs = [squeeze.compress(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), batch.column(batch.schema.get_field_index(key)), pa.array(np.diff(bounds)), *(pa.array(v) for v in vectors.T), pa.array(blobs, pa.binary())],
                names=["part", "row", key, "doc_tokens", "x", "y", "z", "ids"],
            )
            row += n

    return run


def _cut(key: str, length: int):
    def run(batches):
        import zstandard

        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            keys, blobs, places = (batch.column(batch.schema.get_field_index(n)) for n in (key, "ids", "place"))
            rows, starts, sizes, whole, sequences, offsets, parts, held = [], [], [], [], [], [], [], 0

            def out():
                return pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows)), *(pa.array(x, pa.int64()) for x in (starts, sizes, whole, sequences, offsets)), pa.array(parts, pa.binary())],
                    names=[key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

            for row in range(batch.num_rows):
                ids, place, at = np.frombuffer(grow.decompress(blobs[row].as_py()), "<u4"), places[row].as_py(), 0
                while at < len(ids):
                    step = min(len(ids) - at, length - place % length)
                    for column, value in zip((rows, starts, sizes, whole, sequences, offsets, parts), (row, at, step, len(ids), place // length, place % length, ids[at : at + step].tobytes())):
                        column.append(value)
                    at, place, held = at + step, place + step, held + 4 * step
                    if held > 16 << 20:
                        yield out()
                        rows, starts, sizes, whole, sequences, offsets, parts, held = [], [], [], [], [], [], [], 0
            if rows:
                yield out()

    return run


def packed(df: DataFrame, tokenizer: str, length: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit): key, start, length, doc_tokens, sequence_id, offset, ids.

    Texts are encoded once and written; their places on the curve are numbered on rows of a few numbers, then joined to the
    written ids. Null and empty texts hold the end id only and give one piece each; repeated rows give pieces of their own.
    """
    coded = stored(df.select(key, text).mapInArrow(_encoded(key, text, tokenizer), f"part int, row long, {key} {dict(df.dtypes)[key]}, doc_tokens long, x double, y double, z double, ids binary"), "encoded")
    axes = ("x", "y", "z")
    sums = coded.agg(*(f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.avg, F.stddev_pop))).first()
    centre, spread = [sums[f"avg_{a}"] or 0.0 for a in axes], [sums[f"stddev_pop_{a}"] or 1.0 for a in axes]
    small = coded.select("part", "row", "doc_tokens", curve_place([F.col(a) for a in axes], centre, spread).alias("curve"))
    placed = numbered(small, [F.col("curve"), F.col("part"), F.col("row")], "place", weight="doc_tokens").select("part", "row", "place")
    joined = coded.select("part", "row", key, "ids").join(placed, ["part", "row"]).select(key, "ids", "place")
    return joined.mapInArrow(_cut(key, length), f"{key} {dict(df.dtypes)[key]}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
