"""Exact copies: digests that many rows share are found with few counters and dealt with before any shuffle.

A text is named by the SHA-256 of what is left of it without white space. A Misra-Gries summary (Spark's frequent-items
sketch: a bounded number of counters that are all lowered when they run out; summaries of tasks merge) names the digests
that may be frequent. Those are counted exactly, and the ones that really repeat, at most ``WINNERS``, are broadcast with
the row that stays; their rows get their result where they lie. All other digests go through an ordinary aggregation.
The summary decides only which way a digest takes, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanguard.llm.rows import stored

#: Counters of the summary: a digest of more than one row in about 1,200 always has one.
COUNTERS = 4096
#: Most digests that are broadcast, each a row of less than 100 bytes.
WINNERS = 2048
#: What two equal texts may differ in, the class ``[\x20\x09-\x0D]``.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _digests(df: DataFrame, row: Column, key: str, text: str) -> DataFrame:
    """One small row for each row: its number, its key, the digest of its text and how long that is as it stands."""
    digest = F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256))
    chars = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    small = df.select(row.alias("row"), F.col(key).alias("id"), digest.alias("digest"), chars.alias("chars"))
    return stored(small, "digests")


def frequent(rows: DataFrame) -> DataFrame:
    """Column ``short`` (64 bits of a digest): all digests that are frequent, among others, at most ``WINNERS``."""
    part = F.spark_partition_id() % 64  # summaries of many tasks are merged in two steps
    sketches = rows.select(F.xxhash64("digest").alias("short"), part.alias("part")).groupBy("part")
    sketch = sketches.agg(F.expr(f"approx_top_k_accumulate(short, {COUNTERS})").alias("sketch"))
    # Grouped by a constant: without any row there is no group, where a total would ask for the sketch of nothing.
    merged = sketch.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_combine(sketch, {COUNTERS})").alias("sketch"))
    top = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {WINNERS})")).alias("top"))
    return top.select(F.col("top.item").alias("short")).where("short is not null")


def _groups(rows: DataFrame) -> DataFrame:
    """Size of each digest's group and the row that stays: the longest text, then the smallest key (null last)."""
    first = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("unnamed"), "id", "row"))
    return rows.groupBy("digest").agg(F.count("*").alias("group_size"), first.alias("first"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Every row with ``group_size`` and ``first`` of its group."""
    short = F.xxhash64("digest")
    asked = rows.withColumn("short", short).join(F.broadcast(frequent(rows)), "short", "left_semi")
    winners = F.broadcast(stored(_groups(asked).where("group_size > 1"), "winners"))
    removed = rows.join(winners, "digest")
    rest = rows.join(winners, "digest", "left_anti")
    columns = [*rows.columns, "group_size", "first"]
    return removed.select(columns).union(rest.join(_groups(rest), "digest").select(columns))


def marked(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for every row, dropped ones too.

    Texts are equal when they are identical without white space; null counts as empty, and empty texts are a group. Of a
    group the row with the most code points as it stands stays, then the smallest key; a null key comes last. Of rows that
    agree in both, exactly one stays. Nothing else is read; an empty table gives no rows, texts may be of any length.
    """
    rows = _grouped(_digests(df, F.monotonically_increasing_id(), key, text))
    return rows.select(
        F.col("id").alias(key),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of :func:`marked` that stay, with all their columns as they are, whatever these are called."""
    row = "row"
    while row in df.columns:
        row += "_"
    whole = stored(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    kept = _grouped(_digests(whole, F.col(f"`{row}`"), key, text)).where(F.col("row") == F.col("first.row"))
    return whole.join(kept.select(F.col("row").alias(row)), row, "left_semi").select(*(f"`{c}`" for c in df.columns))
