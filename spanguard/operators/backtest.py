"""Replaying the audit pool under another policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanguard.functions.frames import exploded
from spanguard.functions.sqlx import each, struct
from spanguard.operators.policy import Policy
from spanguard.operators.redact import judged
from spanguard.schemas import HIT


def replay_input(fragments: DataFrame, spans: DataFrame) -> DataFrame:
    """The latest row per (content hash, start, end, category), gathered per fragment.

    Spans are reduced by a plain maximum before any text is touched, so content that was seen a million times costs a
    million small rows and one text.  Result: fragment id, text, and its spans with the action they had.
    """
    known = spans.join(fragments.select(F.col("id").alias("fragment_id"), "content_hash"), "fragment_id")
    latest = known.groupBy("content_hash", "byte_start", "byte_end", "entity_group").agg(
        F.max(F.struct("created_at", "seq", "fragment_id", "score", "original_text", "action")).alias("l")
    )
    # One fragment is one text, which bounds what is gathered for it.
    per_fragment = latest.groupBy(F.col("l.fragment_id").alias("id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("byte_start").alias("start"),
                    F.col("byte_end").alias("end"),
                    "entity_group",
                    F.col("l.score").alias("score"),
                    F.col("l.original_text").alias("word"),
                    F.col("l.action").alias("old_action"),
                )
            )
        ).alias("replayed")
    )
    return per_fragment.join(fragments.select("id", F.col("original_text").alias("text")), "id")


def replay(fragments: DataFrame, spans: DataFrame, policy: Policy) -> DataFrame:
    """Every input span decided on its own: old and new action, whether its redaction grew, and the rules that matched."""

    def alone(h: str) -> str:
        fields = {name: f"{h}.{name}" for name in ("entity_group", "score", "start", "end", "word")}
        return f"cast(array({struct(**fields)}) as array<{HIT}>)"

    hits = replay_input(fragments, spans).withColumn("_hits", F.expr(each("replayed", alone)))
    results = judged(hits, policy, "text", "_hits", per="hits").withColumn(
        "judged", F.expr("transform(arrays_zip(replayed, _spans), z -> named_struct('hit', z.replayed, 'result', z._spans))")
    )
    return exploded(results, ["id"], "judged", "j").select(
        F.col("id").alias("fragment_id"),
        F.col("j.hit.start").alias("byte_start"),
        F.col("j.hit.end").alias("byte_end"),
        F.col("j.hit.entity_group").alias("entity_group"),
        F.col("j.hit.old_action").alias("old_action"),
        F.expr("if(exists(j.result, s -> s.action = 'redact'), 'redact', 'release')").alias("new_action"),
        F.expr(
            "exists(j.result, s -> s.action = 'redact' and (s.byte_start < j.hit.start or s.byte_end > j.hit.end))"
        ).alias("expanded"),
        F.expr("array_compact(transform(j.result, s -> s.matched_rule_id))").alias("rule_ids"),
    )


def transitions(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy(F.concat_ws("->", "old_action", "new_action").alias("transition")).agg(
        F.count(F.lit(1)).alias("count")
    )


def expanded_redactions(replayed: DataFrame) -> DataFrame:
    return replayed.agg(F.count_if("expanded").alias("expanded_redactions"))


def rule_hits(replayed: DataFrame, prefix: str = "") -> DataFrame:
    return (
        exploded(replayed, [], "rule_ids", "rule_id")
        .where(F.col("rule_id").startswith(prefix))
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("count"))
    )
