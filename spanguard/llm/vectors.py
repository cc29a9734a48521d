"""Near-duplicate vectors: int8 tile products with error bounds that leave nothing out.

A unit vector u is s·q + e with whole numbers q of one byte and a known norm of e. The product of two quantised vectors is
exact, and differs from the cosine by at most |e_u| + |s_v q_v|·… ≤ ε_u + (1 + ε_u)·ε_v. Pairs whose product cannot reach
the threshold within that bound are left; all others are computed again in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanguard.llm.graph import components
from spanguard.llm.rows import numbered, stored

MOST_BLOCK, LEAST_BLOCK, STRIPE, SLACK = 4096, 256, 512, 1e-5


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. The largest component comes to one first, so no square runs over or under."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers, scale and error norm of unit vectors (rows)."""
    scale = np.maximum(np.abs(units).max(1), 1e-300) / 127
    whole = np.rint(units / scale[:, None])
    return whole.astype(np.int8), scale, np.linalg.norm(units - whole * scale[:, None], axis=1)


def tile_pairs(a, b, same: bool, least: float):
    """Index pairs of rows of two blocks with cosine ≥ ``least``; of one block with itself each pair once.

    A block is (unit vectors in double precision, whole numbers, scales, error norms).
    """
    ua, qa, sa, ea = a
    ub, qb, sb, eb = b
    fb = qb.astype(np.float32)
    parts = range(0, qa.shape[1], 1024)  # sums of 1024 products of bytes are exact in float32
    for low in range(0, len(qa), STRIPE):
        rows = slice(low, low + STRIPE)
        fa = qa[rows].astype(np.float32)
        product = sum(fa[:, p : p + 1024] @ fb[:, p : p + 1024].T for p in parts)
        product *= sb.astype(np.float32)[None, :]
        reach = (least - ea[rows, None] - (1 + ea[rows, None]) * eb.max(initial=0.0) - SLACK) / sa[rows, None]
        r, c = np.nonzero(product >= reach.astype(np.float32))
        keep = c > r + low if same else np.ones(len(r), bool)
        r, c = r[keep] + low, c[keep]
        for at in range(0, len(r), 1 << 16):
            x, y = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
            linked = np.einsum("ij,ij->i", ua[x], ub[y]) >= least
            yield x[linked], y[linked]


def least_labels(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest label reachable over the pairs."""
    while True:
        before = labels.copy()
        low = np.minimum(labels[x], labels[y])
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        if np.array_equal(before, labels):
            return labels


def _prepared(batches):
    for batch in batches:
        vectors = batch.column(batch.schema.get_field_index("vector"))
        whole, scales, errors = [], [], []
        for row in range(batch.num_rows):
            v = vectors[row].values.to_numpy(zero_copy_only=False).astype(np.float64)
            q, s, e = quantised(unit(v[None, :]))
            if not np.isfinite(e).all():
                raise ValueError("a vector without a finite error bound would hide links")
            whole.append(q.tobytes())
            scales.append(s[0])
            errors.append(e[0])
        keep = [batch.column(batch.schema.get_field_index(n)) for n in ("node", "copies", "vector")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(whole, pa.binary()), pa.array(scales), pa.array(errors)], names=["node", "copies", "vector", "whole", "scale", "error"])


def _tile(rows: dict, first: int, second: int, least: float):
    """Links of a tile: node, number of linked vectors, least node of its group in the tile."""
    nodes, copies, blocks = np.array(rows["node"]), np.array(rows["copies"]), np.array(rows["block"])
    sizes = np.array([len(v) for v in rows["vector"]])
    links, pairs_x, pairs_y = np.zeros(len(nodes), np.int64), [], []
    for size in np.unique(sizes).tolist():
        sides = []
        for block in {first: 1, second: 1}:
            at = np.flatnonzero((sizes == size) & (blocks == block))
            vectors = np.array([rows["vector"][i] for i in at], np.float64).reshape(len(at), size)
            units = unit(vectors) if len(at) else vectors
            whole = np.array([np.frombuffer(rows["whole"][i], np.int8) for i in at]).reshape(len(at), size)
            sides.append((at, (units, whole, np.array(rows["scale"])[at], np.array(rows["error"])[at])))
        (ia, a), (ib, b) = sides[0], sides[-1]
        if not len(ia) or not len(ib):
            continue
        for x, y in tile_pairs(a, b, first == second, least):
            x, y = ia[x], ib[y]
            links += np.bincount(x, copies[y], len(nodes)).astype(np.int64) + np.bincount(y, copies[x], len(nodes)).astype(np.int64)
            pairs_x.append(x)
            pairs_y.append(y)
    if not pairs_x:
        return None
    order = np.argsort(np.argsort(nodes))
    labels = least_labels(order.copy(), np.concatenate(pairs_x), np.concatenate(pairs_y))
    hit = np.flatnonzero(links)
    return pa.RecordBatch.from_pydict({"node": nodes[hit], "links": links[hit], "label": np.sort(nodes)[labels[hit]]})


def _searched(least: float):
    names = ("node", "copies", "block", "vector", "whole", "scale", "error")

    def run(batches):
        tile, rows = None, {n: [] for n in names}
        for batch in batches:
            first, second = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("i", "j"))
            edges = [0, *(np.flatnonzero((np.diff(first) != 0) | (np.diff(second) != 0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:]):
                if low == high:
                    continue
                here = (int(first[low]), int(second[low]))
                if tile is not None and here != tile:
                    if (found := _tile(rows, *tile, least)) is not None:
                        yield found
                    rows = {n: [] for n in names}
                tile = here
                for n in names:
                    column = batch.column(batch.schema.get_field_index(n)).slice(low, high - low)
                    rows[n] += [v.values.to_numpy(zero_copy_only=False) for v in column] if n == "vector" else column.to_pylist()
        if tile is not None and (found := _tile(rows, *tile, least)) is not None:
            yield found

    return run


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Vectors that are null, zero, empty or hold a null or non-finite component link with nothing. Equal vectors are
    one node with a number of copies. Nodes are numbered and cut into blocks; every two blocks meet in a tile of its own task
    input, which returns sums and a label for each node, never pairs. Vectors of different lengths do not link. A null key
    is a vector like others, but names no component; ``kept`` is false for it unless nothing names its component.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    whole = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = whole & (F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) > 0)
    reps = rows.where(usable).groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    nodes = stored(numbered(reps, [F.size("vector"), F.col("id").asc_nulls_first(), F.xxhash64("vector")], "node"), "nodes")
    n = nodes.count()
    block = max(LEAST_BLOCK, min(MOST_BLOCK, -(-n // 16)))
    last = max(0, -(-n // block) - 1)
    kind = nodes.schema["vector"].dataType.simpleString()
    ready = nodes.select("node", "copies", "vector").mapInArrow(_prepared, f"node long, copies long, vector {kind}, whole binary, scale double, error double")
    own = F.call_function("div", F.col("node"), F.lit(block).cast("long"))
    dealt = ready.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    found = dealt.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_searched(least), "node long, links long, label long")
    found = stored(found.groupBy("node", "label").agg(F.sum("links").alias("links")), "links")
    groups = components(found, "node", "label")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "id", "copies", "vector").join(links, "node", "left").join(groups, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("id").alias("component_id"))
    facts = named.join(names, "component").select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("known"))
    out = rows.join(facts, "vector", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
