"""Queries on the audit pool: spans grouped by exact text, the review queue, occurrences and their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanguard.functions.ranges import Ordered
from spanguard.operators.policy import keyword_rules, operator_decision
from spanguard.schemas import CATEGORIES

DEFAULT_PAGE, LONGEST_PAGE = 50, 500


def content_summary(spans: DataFrame, evidence: bool = False) -> DataFrame:
    """One row per exact text; with ``evidence`` also its categories, most frequent first, then by name.

    Two aggregations: (text, fragment) first, then text.  The second then counts fragments without a distinct, and a
    text that makes up a third of all spans is spread over its fragments before it meets in one group.  Categories are
    a fixed list, so their counts are plain sums in the same pass.
    """
    latest = F.max(F.struct("created_at", "seq", "id", "action"))
    groups = [name for name, _, _ in CATEGORIES] if evidence else []
    per_fragment = spans.groupBy("original_text", "fragment_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("action") == "release").alias("released"),
        F.count_if(F.col("action") == "redact").alias("redacted"),
        F.min("score").alias("score_min"),
        F.max("score").alias("score_max"),
        F.min("created_at").alias("first_seen"),
        latest.alias("latest"),
        *[F.count_if(F.col("entity_group") == g).alias(f"n_{g}") for g in groups],
    )
    per_text = per_fragment.groupBy("original_text").agg(
        F.sum("n").alias("occurrences"),
        F.count(F.lit(1)).alias("turns"),
        F.sum("released").alias("released"),
        F.sum("redacted").alias("redacted"),
        F.min("score_min").alias("score_min"),
        F.max("score_max").alias("score_max"),
        F.min("first_seen").alias("first_seen"),
        F.max("latest").alias("latest"),
        *[F.sum(f"n_{g}").alias(f"n_{g}") for g in groups],
    )
    columns = [
        "original_text",
        "occurrences",
        "turns",
        "released",
        "redacted",
        "score_min",
        "score_max",
        "first_seen",
        F.col("latest.created_at").alias("last_seen"),
        F.col("latest.id").alias("anchor_span_id"),
        F.col("latest.action").alias("latest_action"),
    ]
    if evidence:
        listed = ", ".join(f"named_struct('rank', -n_{g}, 'entity_group', '{g}')" for g in groups)
        columns.append(
            F.expr(
                f"transform(array_sort(filter(array({listed}), c -> c.rank < 0)),"
                " c -> named_struct('entity_group', c.entity_group, 'count', -c.rank))"
            ).alias("categories")
        )
    return per_text.select(*columns)


def category_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("original_text", "entity_group").agg(F.count(F.lit(1)).alias("count"))


def category_evidence(spans: DataFrame) -> DataFrame:
    """Per text its categories, most frequent first, then by name.  At most one entry per category name."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("rank"), "entity_group")))
    return (
        category_counts(spans)
        .groupBy("original_text")
        .agg(ordered.alias("ranked"))
        .select(
            "original_text",
            F.transform(
                "ranked", lambda r: F.struct(r["entity_group"].alias("entity_group"), (-r["rank"]).alias("count"))
            ).alias("categories"),
        )
    )


def registered_texts(rules: DataFrame) -> DataFrame:
    """Texts of all operator registrations, enabled or not."""
    return keyword_rules(rules).where(F.col("source") == "approval").select("keyword").distinct()


def review(summary: DataFrame, registered: DataFrame, mode: str = "unreviewed") -> DataFrame:
    """Texts that still need a decision, texts that have one, or all; compares the exact text.

    ``registered`` is a table of texts (first column).  Semi and anti joins also hold for an empty table.
    """
    if mode == "all":
        return summary
    known = registered.select(F.col(registered.columns[0]).alias("_text"))
    how = {"unreviewed": "left_anti", "reviewed": "left_semi"}[mode]
    return summary.join(known, F.col("original_text") == F.col("_text"), how)


def is_unstable(released: str = "released", redacted: str = "redacted"):
    return (F.col(released) > 0) & (F.col(redacted) > 0)


def review_order(summary: DataFrame) -> DataFrame:
    return summary.orderBy(is_unstable().desc(), F.desc("occurrences"), F.desc("last_seen"), "original_text")


def page(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One page of an ordered result."""
    size = min(max(DEFAULT_PAGE if limit is None else limit, 1), LONGEST_PAGE)
    return df.offset(max(offset or 0, 0)).limit(size)


class Pages:
    """A review queue whose pages are addressed by rank: sorted by range and written once, then each page reads only its own rows.

    For deep pages and many of them; :func:`page` keeps all rows up to the page, which is cheaper for the first few.
    """

    def __init__(self, summary: DataFrame):
        unstable = is_unstable().desc()
        self._rows = Ordered(summary, [unstable, F.desc("occurrences"), F.desc("last_seen"), F.asc("original_text")])
        self.total = self._rows.total

    def page(self, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """One page in review order, with the ``place`` of each row."""
        size, first = min(max(DEFAULT_PAGE if limit is None else limit, 1), LONGEST_PAGE), max(offset or 0, 0)
        return self._rows.between(first, first + size).orderBy("place")


def content_pages(spans: DataFrame, rules: DataFrame, mode: str = "unreviewed") -> Pages:
    """The review queue with categories, ready for pages at any depth."""
    return Pages(review(content_summary(spans, evidence=True), registered_texts(rules), mode))


def content_count(summary: DataFrame, registered: DataFrame, mode: str = "unreviewed") -> DataFrame:
    return review(summary, registered, mode).agg(F.count(F.lit(1)).alias("total"))


def content_page(
    spans: DataFrame, rules: DataFrame, mode: str = "unreviewed", limit: int | None = None, offset: int | None = None
) -> DataFrame:
    """A page of the review queue (top-k, no full sort) with categories and the registered action."""
    summary = content_summary(spans, evidence=True)
    queue = page(review_order(review(summary, registered_texts(rules), mode)), limit, offset)
    return review_order(operator_decision(queue, rules).drop("registered_rule_id"))


def occurrences(spans: DataFrame, fragments: DataFrame, text: str) -> DataFrame:
    """Where a text occurred, latest first."""
    return _with_provenance(spans.where(F.col("original_text") == text), fragments)


def occurrences_of_span(spans: DataFrame, fragments: DataFrame, span_id: str) -> DataFrame:
    """Where the text of this span occurred, latest first."""
    anchor = find_span(spans, span_id).select("original_text").distinct()
    return _with_provenance(spans.join(anchor, "original_text", "left_semi"), fragments)


def _with_provenance(spans: DataFrame, fragments: DataFrame) -> DataFrame:
    origin = fragments.select(F.col("id").alias("fragment_id"), "api_format", "path")
    return (
        spans.join(origin, "fragment_id")
        .orderBy(F.desc("created_at"), F.desc("seq"))
        .select(
            F.col("id").alias("span_id"),
            "entity_group",
            "score",
            "action",
            "matched_rule_id",
            "api_format",
            "path",
            "created_at",
        )
    )


def find_fragment(fragments: DataFrame, fragment_id: str) -> DataFrame:
    return fragments.where(F.col("id") == fragment_id)


def find_span(spans: DataFrame, span_id: str) -> DataFrame:
    return spans.where(F.col("id") == span_id)


def spans_of(spans: DataFrame, fragment_id: str) -> DataFrame:
    return spans.where(F.col("fragment_id") == fragment_id).orderBy("byte_start", "seq")


def fragment_of_span(fragments: DataFrame, spans: DataFrame, span_id: str) -> DataFrame:
    """The fragment of a span with all its spans by position; one fragment is one text, which bounds the array."""
    owner = find_span(spans, span_id).select("fragment_id").distinct()
    nested = (
        spans.join(owner, "fragment_id", "left_semi")
        .groupBy("fragment_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "byte_start", "seq", "id", "entity_group", "score", "char_len", "byte_end", "original_text",
                        "action", "matched_rule_id",
                    )
                )
            ).alias("spans")
        )
    )
    return fragments.join(nested, fragments["id"] == nested["fragment_id"]).drop("fragment_id")


def with_registered_action(texts: DataFrame, rules: DataFrame) -> DataFrame:
    return operator_decision(texts, rules).drop("registered_rule_id")


def forget_rules(spans: DataFrame, rules: DataFrame) -> DataFrame:
    """Spans keep their decision but lose the reference to a rule that no longer exists."""
    living = rules.select(F.col("id").alias("_rule")).distinct()
    return (
        spans.join(living, spans["matched_rule_id"] == F.col("_rule"), "left")
        .withColumn("matched_rule_id", F.col("_rule"))
        .select(*spans.columns)
    )


def forget_fragments(spans: DataFrame, fragments: DataFrame) -> DataFrame:
    """Spans of fragments that no longer exist go with them."""
    return spans.join(fragments.select(F.col("id").alias("fragment_id")), "fragment_id", "left_semi").select(
        *spans.columns
    )
