"""Request and model statistics, one aggregation per table."""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanguard.functions.ranges import Ordered

HOUR_MS = 3_600_000
DEFAULT_HOURS, MOST_HOURS = 24, 24 * 365

STAGES = ("tokenization", "validation", "forward", "decoding")
PERFORMANCE = "tokens bigint, first_result_ms double, " + ", ".join(f"{s}_ms double" for s in STAGES)


def since(now_ms: int, hours: int | None = None) -> int:
    """Start of the trailing window of ``hours`` before ``now_ms``."""
    return now_ms - min(max(DEFAULT_HOURS if hours is None else hours, 0), MOST_HOURS) * HOUR_MS


def in_window(df: DataFrame, since_ms: int, column: str = "started_at") -> DataFrame:
    return df.where(F.col(column) >= F.lit(since_ms))


def mean_ms(column: str) -> Column:
    """Mean of whole milliseconds, truncated; 0 for no rows."""
    return F.coalesce(F.expr(f"sum({column}) div count({column})"), F.lit(0).cast("bigint"))


def percentile_ms(column: str, fraction: float) -> Column:
    """Nearest-rank percentile; 0 for no rows."""
    ranked = F.expr(f"percentile_disc({fraction}) within group (order by {column})")
    return F.coalesce(ranked.cast("bigint"), F.lit(0).cast("bigint"))


def usage_count(json: str, name: str) -> Column:
    """A whole number in the usage JSON; anything else counts 0."""
    raw = F.get_json_object(json, f"$.{name}")
    whole = F.when(raw.rlike(r"^-?[0-9]+\z"), F.expr(f"try_cast(get_json_object({json}, '$.{name}') as bigint)"))
    return F.sum(F.coalesce(whole, F.lit(0)))


def percentiles(df: DataFrame, column: str, fractions: dict[str, str]) -> DataFrame:
    """Nearest-rank percentiles of whole numbers in one row, by output name; 0 for no rows. Nulls do not count.

    Rows are counted by value, values sorted by range over all tasks, and counts added up along them: the percentile is the first
    value that as many rows reach. No task holds more than its share of the distinct values. Fractions are decimal texts.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    values = Ordered(counts, [F.col(column)], ["_n"])
    reached = values.placed("_place", {"_upto": "_n"})
    ranks = {name: max(1, ceil(Fraction(fraction) * values.totals["_n"])) for name, fraction in fractions.items()}
    first = [F.min(F.when(F.col("_upto") >= rank, F.col(column))) for rank in ranks.values()]
    return reached.agg(*[F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")).alias(name) for name, c in zip(ranks, first)])


def request_columns(ranked: bool = True) -> list[Column]:
    """Aggregates over requests; ``ranked`` ones hold all distinct durations of a group in one place, as a stream must."""
    ranks = [percentile_ms("duration_ms", 0.5).alias("p50_ms"), percentile_ms("duration_ms", 0.95).alias("p95_ms")]
    return [
        F.count(F.lit(1)).alias("requests"),
        mean_ms("duration_ms").alias("average_ms"),
        *(ranks if ranked else ()),
        F.coalesce(F.max("duration_ms"), F.lit(0)).cast("bigint").alias("max_ms"),
        mean_ms("inference_ms").alias("average_inference_ms"),
        mean_ms("upstream_ms").alias("average_upstream_ms"),
        F.coalesce(usage_count("cache_usage_json", "cached_fragments"), F.lit(0)).alias("cached_fragments"),
        F.coalesce(usage_count("cache_usage_json", "inferred_fragments"), F.lit(0)).alias("inferred_fragments"),
    ]


def request_stats(requests: DataFrame, since_ms: int) -> DataFrame:
    """Count, latency and usage of the requests since a time."""
    recent = in_window(requests, since_ms)
    ranks = percentiles(recent, "duration_ms", {"p50_ms": "0.5", "p95_ms": "0.95"})
    return _laid_over(recent.agg(*request_columns(ranked=False)), ranks)




def _laid_over(*sides: DataFrame) -> DataFrame:
    """One-row tables with columns of their own as one row."""
    stacked = sides[0]
    for side in sides[1:]:
        stacked = stacked.unionByName(side, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def span_stats(spans: DataFrame, since_ms: int) -> DataFrame:
    """Spans since a time: all, released, redacted."""
    return in_window(spans, since_ms, "created_at").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if(F.col("action") == "release").alias("released_spans"),
        F.count_if(F.col("action") == "redact").alias("redacted_spans"),
    )


def fragment_stats(fragments: DataFrame, since_ms: int) -> DataFrame:
    return in_window(fragments, since_ms, "created_at").agg(F.count(F.lit(1)).alias("fragments"))


def by_group(spans: DataFrame, since_ms: int) -> DataFrame:
    return (
        in_window(spans, since_ms, "created_at")
        .groupBy("entity_group")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "entity_group")
    )


def ratio(part: str, whole: Column) -> Column:
    """part / whole, 0 instead of a division by zero."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.col(part) / whole)


def statistics(requests: DataFrame, fragments: DataFrame, spans: DataFrame, since_ms: int) -> DataFrame:
    """All counters of the overview in one row: three one-row aggregates laid over each other."""
    joined = _laid_over(request_stats(requests, since_ms), fragment_stats(fragments, since_ms), span_stats(spans, since_ms))
    return joined.select(
        "*",
        ratio("redacted_spans", F.col("spans")).alias("redacted_ratio"),
        ratio("cached_fragments", F.col("cached_fragments") + F.col("inferred_fragments")).alias("cache_hit_ratio"),
    )


def parsed_performance(requests: DataFrame, json: str = "model_performance_json") -> DataFrame:
    """Requests that carry a model sample; a malformed sample fails the job."""
    return requests.where(F.col(json).isNotNull()).withColumn(
        "performance", F.from_json(json, PERFORMANCE, {"mode": "FAILFAST"})
    )


def rate(tokens: Column, forward_ms: Column) -> Column:
    """Tokens per second, null without tokens or time."""
    return F.when((tokens > 0) & (forward_ms > 0), tokens * 1000.0 / forward_ms)


def tokens_per_second(sample: str = "performance") -> Column:
    return rate(F.col(f"{sample}.tokens"), F.col(f"{sample}.forward_ms"))


def model_summary(requests: DataFrame, since_ms: int, order: str = "seq") -> DataFrame:
    """Throughput and mean stage times of measured samples (tokens > 0), and the latest sample of all."""
    measured = F.col("performance.tokens") > 0

    def mean(name: str) -> Column:
        return F.avg(F.when(measured, F.col(f"performance.{name}")))

    tokens = F.sum(F.when(measured, F.col("performance.tokens")))
    forward = F.sum(F.when(measured, F.col("performance.forward_ms")))
    summary = parsed_performance(in_window(requests, since_ms)).agg(
        F.count_if(measured).alias("measured_requests"),
        F.coalesce(tokens, F.lit(0)).alias("tokens"),
        F.when(forward > 0, tokens * 1000.0 / forward).alias("tokens_per_second"),
        mean("first_result_ms").alias("average_first_result_ms"),
        *[mean(f"{s}_ms").alias(f"average_{s}_ms") for s in STAGES],
        F.max_by("performance", F.struct("started_at", order)).alias("latest"),
    )
    return summary.withColumn("latest_tokens_per_second", tokens_per_second("latest"))


def accumulated(calls: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Samples of several model calls added up; the first call that has a first result gives it."""
    return calls.groupBy(*keys).agg(
        F.sum("tokens").alias("tokens"),
        F.min_by("first_result_ms", F.when(F.col("first_result_ms").isNotNull(), F.col(order))).alias("first_result_ms"),
        *[F.sum(f"{s}_ms").alias(f"{s}_ms") for s in STAGES],
    )


def with_next(df: DataFrame, keys: list[str], order: str, tie: str, values: list[str], block: int) -> DataFrame:
    """Add ``next`` = the values of the following row of the same key, by (order, tie).

    Rows are windowed per (key, block of the order column), so a key with very many rows is sorted in many tasks; only
    the first row of each block is looked at across blocks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    inside = Window.partitionBy(*keys, "_block").orderBy(order, tie)
    firsts = blocked.groupBy(*keys, "_block").agg(F.min(F.struct(order, tie, *values)).alias("_first"))
    across = Window.partitionBy(*keys).orderBy("_block")
    following = firsts.select(*keys, "_block", F.lead("_first").over(across).alias("_following"))
    return (
        blocked.withColumn("_lead", F.lead(F.struct(order, tie, *values)).over(inside))
        .join(following, [*keys, "_block"], "left")
        .withColumn("next", F.coalesce("_lead", "_following"))
        .drop("_lead", "_following", "_block")
    )


def stage_times(events: DataFrame, keys: list[str], block_ms: int = 86_400_000) -> DataFrame:
    """Milliseconds per key and stage from a log of ``begin`` and ``end`` marks.

    A stage lasts from its begin mark to the next mark if that ends it; a stage that is begun anew before it ended
    counts from the later begin.  Columns: keys, ``ts_ms``, ``seq``, ``mark``, ``stage``.
    """
    paired = with_next(events, keys, "ts_ms", "seq", ["mark"], block_ms).where(
        (F.col("mark") == "begin") & (F.col("next.mark") == "end")
    )
    return paired.groupBy(*keys, "stage").agg(
        F.sum(F.col("next.ts_ms") - F.col("ts_ms")).alias("stage_ms"), F.count(F.lit(1)).alias("calls")
    )


def progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs, tokens and batches completed, from completion marks with a token count."""
    return events.groupBy(*keys).agg(
        F.count_if(F.col("mark") == "input").alias("completed_inputs"),
        F.coalesce(F.sum(F.when(F.col("mark") == "input", F.col("tokens"))), F.lit(0)).alias("completed_tokens"),
        F.count_if(F.col("mark") == "batch").alias("completed_batches"),
    )
