"""The whole pipeline over a table of texts, and the audit rows it leaves.  Map-only: a text never leaves its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanguard.functions.frames import exploded, with_rows_where
from spanguard.operators.merge import combined
from spanguard.operators.policy import Policy
from spanguard.operators.recognize import Recognizers
from spanguard.operators.redact import redact
from spanguard.operators.registrations import with_policy_hits
from spanguard.operators.ruletable import RuleTable
from spanguard.operators.scoring import Scorer, hits_column

#: Span ordinals inside one fragment; seq = fragment ordinal * SPAN_SLOTS + span ordinal.
SPAN_SLOTS = 1 << 24


def combined_hits(
    df: DataFrame,
    text: str = "text",
    scorer: Scorer | None = None,
    recognizers: Recognizers | None = None,
    output: str = "hits",
) -> DataFrame:
    """Add the hits of recognizers and scorer, merged by category."""
    recognizers = recognizers or Recognizers()
    scored = hits_column(df, scorer, text, "_scored")
    certain = recognizers.with_hits(scored, text, "_certain")
    return certain.withColumn(
        output, F.expr(combined("_certain", "_scored", recognizers.authoritative()))
    ).drop("_certain", "_scored")


def redact_scored(
    df: DataFrame,
    policy: Policy | RuleTable,
    scored: str,
    text: str = "text",
    recognizers: Recognizers | None = None,
) -> DataFrame:
    """Everything after the scorer: recognizers, merge, registered texts, decisions, redaction.

    ``scored`` is an ``array<HIT>`` column; it may come from a scorer or from stored results.
    """
    recognizers = recognizers or Recognizers()
    policy = policy.narrowed(df, text) if isinstance(policy, RuleTable) else policy
    certain = recognizers.with_hits(df, text, "_certain")
    registered = with_policy_hits(certain, text, "_registered", policy)
    merged = combined("_certain", f"`{scored}`", recognizers.authoritative())
    plain = isinstance(policy, Policy) and not policy.registrations()
    joined = registered.withColumn(
        "_hits", F.expr(merged if plain else f"concat({merged}, _registered)")
    ).drop("_certain", "_registered")
    return redact(joined, policy, text, "_hits").drop("_hits")


def run_pipeline(
    df: DataFrame,
    policy: Policy | RuleTable,
    text: str = "text",
    scorer: Scorer | None = None,
    recognizers: Recognizers | None = None,
) -> DataFrame:
    """Add ``spans``, ``redact_ranges``, ``redacted_text``, ``released``, ``redacted`` and ``changed``."""
    scored = hits_column(df, scorer, text, "_scored")
    return redact_scored(scored, policy, "_scored", text, recognizers).drop("_scored")


def pool_rows(redacted: DataFrame, text: str = "text", already_audited: Column | None = None) -> DataFrame:
    """Fragment rows with their nested spans: only texts with spans that were not audited before.

    Input columns ``id``, ``request_id``, ``api_format``, ``path``, ``ordinal`` and ``created_at`` say where a text
    came from.  Fragment and spans stay one row, so they are written together or not at all.
    """
    wanted = F.size("spans") > 0
    if already_audited is not None:
        wanted = wanted & ~already_audited
    recorded = F.expr(
        f"""transform(spans, (s, i) -> named_struct(
            'id', concat(id, ':', i), 'entity_group', s.entity_group, 'score', s.score,
            'char_len', char_length(s.original_text), 'byte_start', s.byte_start, 'byte_end', s.byte_end,
            'original_text', s.original_text, 'action', s.action, 'matched_rule_id', s.matched_rule_id,
            'seq', ordinal * {SPAN_SLOTS} + i))"""
    )
    return with_rows_where(redacted, wanted).select(
        "id",
        "request_id",
        "api_format",
        "path",
        F.unhex(F.sha2(F.col(text), 256)).alias("content_hash"),
        F.col(text).alias("original_text"),
        "redacted_text",
        F.col("created_at").cast("bigint").alias("created_at"),
        recorded.alias("spans"),
    )


def fragments(pool: DataFrame) -> DataFrame:
    return pool.drop("spans")


def spans(pool: DataFrame) -> DataFrame:
    return exploded(pool, [F.col("id").alias("fragment_id"), "created_at"], "spans", "s").select(
        "s.id",
        "fragment_id",
        "s.entity_group",
        "s.score",
        "s.char_len",
        "s.byte_start",
        "s.byte_end",
        "s.original_text",
        "s.action",
        "s.matched_rule_id",
        "created_at",
        "s.seq",
    )
