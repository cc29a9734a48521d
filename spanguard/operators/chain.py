"""Incremental work: content hashes, turn chains, and what a cache would keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanguard.functions.ranges import Ordered
from spanguard.operators.scoring import Scorer

CHAIN_VERSION = "turn-chain-2"
#: Turn numbers whose sums are made in one task.
CHAIN_BLOCK = 2048
#: Numbers of 60 bits that a digest gives.
CHAIN_LANES = 4
DEFAULT_ENTRIES, DEFAULT_BYTES = 4096, 16 * 1024 * 1024


def content_hash(text: str) -> Column:
    return F.sha2(F.col(text), 256)


def identity(**parameters: object) -> str:
    """Fingerprint of a scorer and its settings; different settings never share stored results."""
    import hashlib

    listed = "\x1f".join(f"{k}={parameters[k]!r}" for k in sorted(parameters))
    return hashlib.sha256(listed.encode()).hexdigest()


# ---------------------------------------------------------------------------------------------------------------
# Equal texts
# ---------------------------------------------------------------------------------------------------------------


def dedup_score(df: DataFrame, scorer: Scorer, text: str = "text", output: str = "hits") -> DataFrame:
    """Score every distinct text once and hand the hits to all rows that hold it; an empty text has none.

    One row per hash is scored.  The way back joins on the hash with one row on the right, a shape in which adaptive
    execution splits a hash that very many rows share.
    """
    keyed = df.withColumn("_hash", F.when(F.col(text) != "", content_hash(text)))
    distinct = keyed.where(F.col("_hash").isNotNull()).select("_hash", F.col(text).alias("_text")).dropDuplicates(["_hash"])
    scored = scorer.with_hits(distinct, "_text", output).select("_hash", output)
    joined = keyed.join(scored, "_hash", "left").drop("_hash")
    nothing = F.array().cast(dict(scored.dtypes)[output])
    return joined.withColumn(output, F.coalesce(output, nothing))


def cache_usage(df: DataFrame, cached_hashes: DataFrame, text: str = "text") -> DataFrame:
    """How many rows a cache answers, how many share a text that is scored anyway, and how many texts are scored."""
    per_text = (
        df.where(F.col(text) != "").groupBy(content_hash(text).alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    )
    known = cached_hashes.select(F.col(cached_hashes.columns[0]).alias("hash")).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    return per_text.join(known, "hash", "left").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("cached_fragments"),
        F.coalesce(F.sum(F.when(~hit, F.col("n") - 1)), F.lit(0)).alias("deduplicated_fragments"),
        F.count_if(~hit).alias("inferred_fragments"),
    )


def retained(
    accesses: DataFrame, max_entries: int = DEFAULT_ENTRIES, max_bytes: int = DEFAULT_BYTES
) -> DataFrame:
    """What a least-recently-used cache holds after an access log: columns ``key``, ``bytes``, ``at``.

    An entry larger than the budget is never kept. The last accesses are sorted by range over all tasks, newest first, with their
    places and running sums, so budgets may be of any size.
    """
    if max_entries < 1 or max_bytes < 1:
        raise ValueError("limits must be positive")
    last = (
        accesses.where(F.col("bytes") <= max_bytes)
        .groupBy("key")
        .agg(F.max("at").alias("at"), F.max_by("bytes", "at").alias("bytes"))
    )
    newest_first = Ordered(last, [F.desc("at"), F.asc("key")], ["bytes"])
    placed = newest_first.placed("_place", {"_total": "bytes"})
    return placed.where((F.col("_place") < max_entries) & (F.col("_total") <= max_bytes)).select("key", "at", "bytes")


# ---------------------------------------------------------------------------------------------------------------
# Turn chains
# ---------------------------------------------------------------------------------------------------------------


def chain_root(scorer_identity: str, api_format: str = "conversation") -> str:
    return identity(version=CHAIN_VERSION, scorer=scorer_identity, format=api_format)


def turn_chain(
    turns: DataFrame,
    root: str,
    keys: Sequence[str] = ("conv_id",),
    turn: str = "turn",
    content: Sequence[str] = ("role", "text"),
    block: int = CHAIN_BLOCK,
) -> DataFrame:
    """Add ``hash`` and ``parent_hash``: a turn's hash covers everything up to it.

    A turn is reduced to a digest, which is hashed with the turn's place in its conversation and cut into four numbers.
    The hash of a turn is the hash of the root, its place and the running sums of those numbers.  It depends on nothing but
    the contents up to the turn: equal prefixes share hashes whatever their turns are numbered, an edit branches off.
    Sums are made inside blocks of turn numbers and carried on from block to block, so a long conversation is dealt to
    many tasks; ``block`` changes nothing in the result.  Null keys are a conversation like others; turns with one
    number follow each other in the order of their digests, every row keeps its own hash.
    """
    keys = list(keys)
    digest = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content])), 256)
    # A struct is never null, so null keys join and group like values.
    group = F.struct(*keys, F.floor(F.col(turn) / block).alias("_block"))
    base = turns.withColumn("_digest", digest).withColumn("_group", group)
    small = base.select("_group", turn, "_digest")
    conversation = F.struct(*[F.col(f"_group.{k}") for k in keys])
    earlier = (
        Window.partitionBy(conversation)
        .orderBy(F.col("_group._block").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = Window.partitionBy("_group").orderBy(F.col(turn).asc_nulls_first(), "_digest")
    lanes = [f"_lane{i}" for i in range(CHAIN_LANES)]
    zero = F.lit(0).cast("decimal(38,0)")

    ahead = small.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    ahead = ahead.select("_group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"))

    def placed(rows: DataFrame) -> DataFrame:
        numbered = rows.join(ahead, "_group").withColumn("_place", F.col("_ahead") + F.row_number().over(inside))
        numbered = numbered.withColumn("_mixed", F.sha2(F.concat_ws(":", "_place", "_digest"), 256))
        return numbered.withColumns(
            {
                lane: F.conv(F.substring("_mixed", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
                for i, lane in enumerate(lanes)
            }
        )

    totals = placed(small).groupBy("_group").agg(*[F.sum(lane).alias(lane) for lane in lanes])
    before = totals.select(
        "_group", *[F.coalesce(F.sum(lane).over(earlier).cast("decimal(38,0)"), zero).alias(f"_before{lane}") for lane in lanes]
    )
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    summed = placed(base).join(before, "_group")
    summed = summed.withColumns(
        {f"_sum{lane}": F.col(f"_before{lane}") + F.sum(lane).over(running).cast("decimal(38,0)") for lane in lanes}
    )

    def hashed(place: Column, sums: list[Column]) -> Column:
        return F.sha2(F.concat_ws(":", F.lit(root), place, *[x.cast("decimal(38,0)") for x in sums]), 256)

    last = hashed(F.col("_place") - 1, [F.col(f"_sum{lane}") - F.col(lane) for lane in lanes])
    return (
        summed.withColumn("hash", hashed(F.col("_place"), [F.col(f"_sum{lane}") for lane in lanes]))
        .withColumn("parent_hash", F.when(F.col("_place") == 1, F.lit(root)).otherwise(last))
        .select(*turns.columns, "hash", "parent_hash")
    )


def lookup_nodes(chained: DataFrame, nodes: DataFrame) -> DataFrame:
    """Turns with their stored node, if any: ``stored_parent``, ``stored_hits`` and ``already_audited``.

    A node that was stored twice counts once.
    """
    stored = nodes.groupBy(F.col("hash").alias("_h")).agg(F.min(F.struct("parent_hash", "hits")).alias("_n"))
    stored = stored.select("_h", F.col("_n.parent_hash").alias("stored_parent"), F.col("_n.hits").alias("stored_hits"))
    return (
        chained.join(stored, chained["hash"] == F.col("_h"), "left")
        .withColumn("already_audited", F.col("_h").isNotNull())
        .drop("_h")
    )


def node_violations(replayed: DataFrame, text: str = "text") -> DataFrame:
    """Stored results that do not fit their turn: other parent, other number of fields, or a word that is no slice."""
    wrong_word = F.expr(
        f"exists(stored_hits, h -> h.end > octet_length(`{text}`)"
        f" or cast(substring(cast(`{text}` as binary), h.start + 1, h.end - h.start) as string) <> h.word)"
    )
    return replayed.where("already_audited").select(
        "hash",
        F.when(F.col("stored_parent") != F.col("parent_hash"), "parent")
        .when(F.col("stored_hits").isNull(), "fields")
        .when(wrong_word, "offsets")
        .alias("violation"),
    ).where(F.col("violation").isNotNull())


def replay_or_score(replayed: DataFrame, scorer: Scorer, text: str = "text", output: str = "hits") -> DataFrame:
    """Stored hits for turns that were scored before, fresh ones for the rest (scored once per distinct text)."""
    old = replayed.where("already_audited").withColumn(output, F.col("stored_hits"))
    new = dedup_score(replayed.where("not already_audited"), scorer, text, output)
    return old.unionByName(new)


def new_nodes(scored: DataFrame, hits: str = "hits") -> DataFrame:
    """Nodes to append: one per new hash.  Nodes of replaced turns stay where they are."""
    return (
        scored.where("not already_audited")
        .select("hash", "parent_hash", F.col(hits).alias("hits"))
        .dropDuplicates(["hash"])
    )
