"""Merging hits of one text: arbitration, combination with scorer hits, and reconciling overlapping windows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from spanguard.functions.offsets import overlaps
from spanguard.functions.sqlx import each, each_indexed, empty, fold, islands, keep, let, lit, some, struct
from spanguard.schemas import HIT, specificity

_RANKED = f"struct<rank:int,start:int,end:int,ord:int,hit:{HIT}>"
_PLACED = f"struct<start:int,end:int,ord:int,hit:{HIT}>"
_GROUPED = f"struct<key:string,start:int,end:int,ord:int,certain:boolean,hit:{HIT}>"


def by_position(hits: str) -> str:
    """Stable order by (start, end)."""
    placed = each_indexed(hits, lambda h, i: struct(start=f"{h}.start", end=f"{h}.end", ord=i, hit=h))
    return each(f"array_sort({placed})", lambda p: f"{p}.hit")


def arbitrated(hits: str) -> str:
    """Greedy by (specificity, start, end): a hit stays unless it overlaps one that was accepted before it."""
    placed = each_indexed(hits, lambda h, i: struct(start=f"{h}.start", end=f"{h}.end", ord=i, hit=h))

    def settle(run: str) -> str:
        ranked = each(
            run,
            lambda p: struct(
                rank=specificity(f"{p}.hit.entity_group"),
                start=f"{p}.start",
                end=f"{p}.end",
                ord=f"{p}.ord",
                hit=f"{p}.hit",
            ),
        )
        accepted = fold(
            f"array_sort({ranked})",
            empty(_RANKED),
            lambda acc, x: f"if({some(acc, lambda a: overlaps(a, x))}, {acc}, array_append({acc}, {x}))",
        )
        return f"if(size({run}) = 1, {each(run, lambda p: f'{p}.hit')}, {by_position(each(accepted, lambda a: f'{a}.hit'))})"

    many = f"flatten({each(islands(f'array_sort({placed})', _PLACED), settle)})"
    return f"if(size({hits}) <= 1, {hits}, {many})"


def combined(certain: str, scored: str, authoritative: Iterable[str]) -> str:
    """Deterministic hits plus those scorer hits they leave room for, by position.

    A scorer has no say in an authoritative category, and elsewhere not where a deterministic hit of the same category
    overlaps.  Overlaps between categories stay; the policy settles them.
    """
    closed = ", ".join(lit(g) for g in authoritative)
    is_open = "true" if not closed else "not ({h}.entity_group in (" + closed + "))"

    def merge(open_hits: str) -> str:
        grouped = "concat({}, {})".format(
            each_indexed(open_hits, lambda h, i: _grouped(h, i, "false")),
            each_indexed(certain, lambda h, i: _grouped(h, f"size({open_hits}) + {i}", "true")),
        )

        def settle(run: str) -> str:
            kept = keep(run, lambda x: f"{x}.certain or not {some(run, lambda y: f'({y}.certain and {overlaps(x, y)})')}")
            return f"if(size({run}) = 1, {run}, {kept})"

        survivors = f"flatten({each(islands(f'array_sort({grouped})', _GROUPED, key='key'), settle)})"
        ordered = each(
            survivors, lambda x: struct(start=f"{x}.start", end=f"{x}.end", ord=f"{x}.ord", hit=f"{x}.hit")
        )
        return f"if(size({open_hits}) = 0, {certain}, {each(f'array_sort({ordered})', lambda p: f'{p}.hit')})"

    return let(keep(scored, lambda h: is_open.format(h=h)), merge)


def _grouped(h: str, ordinal: str, certain: str) -> str:
    return struct(
        key=f"{h}.entity_group", start=f"{h}.start", end=f"{h}.end", ord=ordinal, certain=certain, hit=h
    )


def reconcile(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Union of overlapping hits of one category, with their best score; touching hits stay apart.

    Input has ``keys``, ``entity_group``, ``start``, ``end`` and ``score`` in whole-text offsets.  Sorting inside
    (keys, category) with a running maximum of the end: any number of hits of one text can spill to disk.
    """
    order = Window.partitionBy(*keys, "entity_group").orderBy("start", "end", "score")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        hits.withColumn("reach", F.max("end").over(before))
        .withColumn("opens", F.when(F.col("reach").isNull() | (F.col("start") >= F.col("reach")), 1).otherwise(0))
        .withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "entity_group", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))
        .drop("island")
    )


#: Widths of bins; a span lies in one or two bins of the first width that is not less than its length, and of every wider one.
BIN_WIDTHS = tuple(64 * 4**level for level in range(13))


def _in_bins(spans: DataFrame, keys: list[str], side: str) -> DataFrame:
    """A row for each bin a span lies in, from its own width on; the span as a struct, null keys as values."""
    level = F.lit(len(BIN_WIDTHS) - 1)
    for number in reversed(range(len(BIN_WIDTHS) - 1)):
        level = F.when(F.col("end") - F.col("start") <= BIN_WIDTHS[number], number).otherwise(level)
    width = F.get(F.array(*[F.lit(w).cast("bigint") for w in BIN_WIDTHS]), F.col("_wide"))
    rows = spans.select(F.struct(*keys).alias("_key"), "start", "end", level.alias(f"_level_{side}"), F.struct(*spans.columns).alias(side))
    wide = rows.withColumn("_wide", F.explode(F.sequence(F.col(f"_level_{side}"), F.lit(len(BIN_WIDTHS) - 1)))).withColumn("_width", width)
    bins = F.sequence(F.expr("start div _width"), F.expr("greatest(end - 1, start) div _width"))
    return wide.withColumn("_bin", F.explode(bins)).drop("start", "end", "_width")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of spans (structs ``a`` and ``b``) of two tables that have the same ``keys`` and overlap; touching ones do not.

    A join on key and bin: two spans meet in bins of the width that suits the longer one, and the bin that holds the later of
    their starts owns the pair, so each pair is found once. A span makes at most two rows for each width, however long it is; no
    text or key gathers its spans in one task. Offsets are not negative. Null keys are values; a null offset overlaps nothing.
    """
    a, b = _in_bins(left, keys, "a"), _in_bins(right, keys, "b")
    met = a.join(b, ["_key", "_wide", "_bin"])
    width = F.get(F.array(*[F.lit(w).cast("bigint") for w in BIN_WIDTHS]), F.col("_wide"))
    suits = F.col("_wide") == F.greatest("_level_a", "_level_b")
    owner = F.col("_bin") == F.call_function("div", F.greatest("a.start", "b.start").cast("bigint"), width)
    strict = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return met.where(suits & owner & strict).select("a", "b")
