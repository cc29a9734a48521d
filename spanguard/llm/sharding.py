"""Reproducible shuffle into shards: a Feistel permutation of global row numbers with cycle walking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from spanguard.llm.rows import numbered

#: Two primes below 2^31 and multipliers: every product stays below 2^62.
_P, _Q, _A, _B = 2147483647, 2147483629, 1103515245, 1597334677


def sides(n: int) -> tuple[int, int]:
    """Two factors near the root of ``n`` whose product is ``n`` or little more."""
    left = max(1, math.isqrt(max(n, 1)))
    return left, -(-max(n, 1) // left)


def round_keys(seed: int, rounds: int) -> list[int]:
    keys, value = [], (seed * 2654435761 + 97) % _P
    for _ in range(rounds):
        value = (value * 48271 + 11) % _P
        keys.append(value)
    return keys


def quotient(value: Column, by: int) -> Column:
    return F.call_function("div", value.cast("long"), F.lit(by).cast("long"))


def permuted(number: Column, n: int, seed: int = 0, rounds: int = 6) -> Column:
    """A permutation of 0 … n-1: additive Feistel rounds over two digits, walked along its cycle until below ``n``.

    The digits' product exceeds ``n`` by less than its root, so a step leaves the range rarely; the walk from a number
    inside passes each number outside at most once, which bounds it. Past 64 steps (never, for a keyed permutation of
    this size) the query fails instead of returning a doubtful place.
    """
    left, right = sides(n)
    outside = left * right - n

    def mixed(value: Column, key: Column) -> Column:
        return (((value * _A + key) % _P) * _B + key) % _Q

    def step(state: Column, turn: Column) -> Column:
        low, high, key = state["l"], state["r"], turn["key"]
        return F.when(turn["odd"], F.struct(((low + mixed(high, key)) % left).alias("l"), high.alias("r"))).otherwise(
            F.struct(low.alias("l"), ((high + mixed(low, key)) % right).alias("r"))
        )

    turns = F.array(*(F.struct(F.lit(key).cast("long").alias("key"), F.lit(i % 2 == 1).alias("odd")) for i, key in enumerate(round_keys(seed, rounds))))

    def once(value: Column) -> Column:
        start = F.struct(quotient(value, right).alias("l"), (value % right).cast("long").alias("r"))
        return F.aggregate(turns, start, step, lambda s: (s["l"] * right + s["r"]).cast("long"))

    walk = F.sequence(F.lit(0), F.lit(min(outside, 64)))
    place = F.aggregate(walk, F.lit(-1).cast("long"), lambda x, i: F.when(i == 0, once(number)).when(x >= n, once(x)).otherwise(x))
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("cycle walk left the range")).cast("long"))


def sharded(df: DataFrame, order: list[Column], shards: int, seed: int = 0, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Deals all rows into ``shards`` whose counts are at most one apart, in an order shuffled by ``seed``.

    Rows are numbered in ``order`` (make it total: equal rows are numbered in any order, which no reader can tell), the
    numbers are permuted, and the permuted number gives shard (its remainder) and slot (its quotient): both can be
    computed for any row number without reading another row. Nulls in the order come first; an empty table gives none.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    rows = numbered(df, order, "__number")
    n = rows.count()
    place = F.col("__place")
    return (
        rows.withColumn("__place", permuted(F.col("__number"), n, seed))
        .withColumn(shard, (place % shards).cast("int"))
        .withColumn(slot, quotient(place, shards))
        .drop("__number", "__place")
    )
