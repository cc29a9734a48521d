"""Connected components of a table of edges, by stars that shrink to one for each component."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanguard.llm.rows import stored

SALTS = 8


def _with_least(pairs: DataFrame, mins: DataFrame) -> DataFrame:
    """Pairs (u, v) with the least neighbour of u; the one row of a crowded u is dealt out, so its pairs can be too."""
    salt = F.pmod(F.xxhash64("u", "v"), F.lit(SALTS)).cast("int")
    copies = mins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pairs.withColumn("salt", salt).join(copies, ["u", "salt"])


def _step(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = _with_least(both, mins).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = stored(large, "edges")
    mins = large.groupBy("u").agg(F.min("v").alias("m"))
    small = _with_least(large, mins).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored(small.union(mins.select("u", F.col("m").alias("v"))).distinct(), "edges")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, which has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of an edge between two nodes.

    Each round joins every node to the least of its neighbours, first from the greater side, then from the smaller; rounds
    grow with the logarithm of the longest path. Rounds are written to the shared folder. Edges with nulls, loops and
    repeated edges change nothing.
    """
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _are_stars(now):
        now = _step(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
