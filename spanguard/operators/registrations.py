"""Registered texts: every occurrence is a hit, also overlapping ones and inside words.

All of them are searched in one pass over each text by an automaton in an Arrow batch function; one pass per
registration would multiply the work by their number.  Case is folded in one way, whatever their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanguard.functions.frames import exploded
from spanguard.functions.occurrences import automaton, byte_offsets
from spanguard.functions.sqlx import each, empty
from spanguard.functions.worker import latest
from spanguard.operators.policy import Policy, Registration, decision_priority, keyword_rules
from spanguard.operators.ruletable import RuleTable
from spanguard.schemas import HIT

ARROW_HITS = pa.list_(pa.struct([("entity_group", pa.string()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("word", pa.string())]))

#: The pattern list is shipped to every task; more characters than this are refused instead of broadcast.
MAX_PATTERN_CHARACTERS = 64_000_000


def _fold(character: str) -> str:
    """One character for one character; equal lower-cased texts of equal length fold to equal texts."""
    lowered = character.lower()
    if len(lowered) != 1:
        return character
    return "σ" if lowered == "ς" else lowered


def _folded(text: str) -> str:
    """Every character of a text through :func:`_fold`, at once: of all characters only İ has a longer small form."""
    if text.isascii():
        return text.lower()
    return "İ".join(part.lower() for part in text.split("İ")).replace("ς", "σ")


def _scan_registered(text: str, registrations: tuple[tuple[str, str, bool], ...], machine) -> list[tuple]:
    found = []
    for last, indexes in machine.iter(_folded(text)):
        for index in indexes:
            needle, group, sensitive = registrations[index]
            first = last + 1 - len(needle)
            window = text[first : last + 1]
            if window == needle or (not sensitive and window.lower() == needle.lower()):
                found.append((index, first, window, group))
    found.sort(key=lambda f: f[:2])
    offsets = byte_offsets(text) if found else ()
    return [
        dict(entity_group=group, score=1.0, start=int(offsets[first]), end=int(offsets[first + len(window)]), word=window)
        for _, first, window, group in found
    ]


def with_registered_hits(
    df: DataFrame,
    text: str,
    output: str,
    registrations: Sequence[Registration],
    nested: bool = False,
) -> DataFrame:
    """Add ``output``: the hits of all registrations, in their order and then by position.

    With ``nested`` the input column is an array of texts and the output has one hit array for each.
    """

    if not registrations:
        nothing = each(f"`{text}`", lambda t: empty(HIT)) if nested else empty(HIT)
        return df.withColumn(output, F.expr(nothing))
    total = sum(len(r.text) for r in registrations)
    if total > MAX_PATTERN_CHARACTERS:
        raise ValueError(f"registered texts hold {total} characters; at most {MAX_PATTERN_CHARACTERS} can be shipped")

    listed = tuple((r.text, r.group, r.case_sensitive) for r in registrations)
    shipped, version = df.sparkSession.sparkContext.broadcast(listed), uuid.uuid4().hex

    def machine():
        """The automaton, made once in a worker process and kept from task to task."""
        return latest("registered texts", version, lambda: automaton([_folded(p[0]) for p in shipped.value]))

    # Texts are taken out of a batch one at a time, so a worker holds a batch once and no second form of it.
    @F.arrow_udf(f"array<{HIT}>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns, found = shipped.value, machine()
        for texts in batches:
            read = (t.as_py() for t in texts)
            yield pa.array([None if t is None else _scan_registered(t, patterns, found) for t in read], ARROW_HITS)

    @F.arrow_udf(f"array<array<{HIT}>>")
    def search_all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        patterns, found = shipped.value, machine()
        for lists in batches:
            read = (x.as_py() for x in lists)
            yield pa.array([None if x is None else [_scan_registered(t, patterns, found) for t in x] for x in read], pa.list_(ARROW_HITS))

    return df.withColumn(output, (search_all if nested else search)(F.col(text)))


def with_policy_hits(df: DataFrame, text: str, output: str, policy: Policy | RuleTable, nested: bool = False) -> DataFrame:
    """Add ``output``: the hits of what a policy has registered, compiled or as a table."""
    if isinstance(policy, Policy):
        return with_registered_hits(df, text, output, policy.registrations(), nested)
    return policy.with_registered_hits(df, text, output, nested)


def registered_hits(df: DataFrame, registrations: Sequence[Registration], text: str = "text") -> DataFrame:
    """One row per occurrence of a registered text."""
    kept = [c for c in df.columns if c != text]
    found = with_registered_hits(df, text, "_hits", registrations)
    return exploded(found, kept, "_hits", "hit").select(*kept, "hit.*")


# ---------------------------------------------------------------------------------------------------------------
# Decisions on registered texts, as tables
# ---------------------------------------------------------------------------------------------------------------


def apply_decisions(rules: DataFrame, decisions: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Record one decision per text; returns (new rules table, outcome per decision).

    ``decisions`` has ``original_text``, ``action``, ``entity_group`` and ``new_id`` (used only if the text has no
    registration yet).  Texts that differ in case only are one text: the last decision on it counts (by ``order``, then by
    ``new_id``), and every decision gets the outcome of that one.  The registration that counts is kept and rewritten, all
    other registrations of the text go.  A decision that repeats the only registration changes nothing.
    """
    columns = rules.columns
    operator = keyword_rules(rules, nested=True).where(F.col("source") == "approval")
    given = decisions.where(F.col("original_text").isNotNull()).withColumn("_text", F.lower("original_text"))
    place = F.struct(*([F.col(order)] if order else []), "new_id", "original_text")
    asked = (
        given.groupBy("_text")
        .agg(
            F.max_by(F.struct("original_text", "action", "entity_group", "new_id"), place).alias("_d"),
            F.collect_set("original_text").alias("_spellings"),
        )
        .select("_text", "_spellings", "_d.original_text", F.col("_d.action").alias("new_action"), "_d.entity_group", "_d.new_id")
    )
    # A decision meets every registration of its text: the exact ones in any spelling it was decided on.
    pairs = (
        operator.alias("r")
        .join(asked.alias("d"), F.lower("r.keyword") == F.col("d._text"))
        .where(F.expr("not r.case_sensitive or array_contains(d._spellings, r.keyword)"))
        .select("r.*", "d._text", "d.new_action")
    )
    per_text = Window.partitionBy("_text")
    ranked = pairs.withColumn(
        "place", F.row_number().over(per_text.orderBy(F.desc("priority"), "id"))
    ).withColumn("registered", F.count(F.lit(1)).over(per_text))
    survivors = ranked.where("place = 1").withColumn(
        "changed", (F.col("action") != F.col("new_action")) | (F.col("registered") > 1)
    )

    def profile(action):
        return F.when(action == "redact", F.lit(decision_priority("redact"))).otherwise(
            F.lit(decision_priority("release"))
        )

    rewritten = survivors.where("changed").select(
        "id",
        F.concat(F.lit("approval."), F.col("new_action")).alias("name"),
        profile(F.col("new_action")).alias("priority"),
        "condition_json",
        F.col("new_action").alias("action"),
        "enabled",
        "source",
        "category",
    )
    stale = ranked.where("place > 1").select("id").unionByName(survivors.where("changed").select("id")).distinct()
    fresh = asked.join(survivors.select("_text"), "_text", "left_anti")
    created = fresh.select(
        F.col("new_id").alias("id"),
        F.concat(F.lit("approval."), F.col("new_action")).alias("name"),
        profile(F.col("new_action")).alias("priority"),
        F.to_json(
            F.struct(
                F.lit("filter").alias("kind"),
                F.struct(
                    F.lit("keyword").alias("kind"),
                    F.struct(
                        F.col("original_text").alias("text"),
                        F.lit("exact").alias("kind"),
                        F.lit(False).alias("case_sensitive"),
                    ).alias("pattern"),
                ).alias("filter"),
            )
        ).alias("condition_json"),
        F.col("new_action").alias("action"),
        F.lit(True).alias("enabled"),
        F.lit("approval").alias("source"),
        F.col("entity_group").alias("category"),
    )
    kept = rules.join(stale, "id", "left_anti")
    of_text = survivors.select("_text", F.col("id").alias("rule_id"), "changed").unionByName(
        fresh.select("_text", F.col("new_id").alias("rule_id"), F.lit(True).alias("changed"))
    )
    outcome = given.select("original_text", "_text").join(of_text, "_text").select("original_text", "rule_id", "changed")
    new_rules = kept.select(*columns).unionByName(rewritten.select(*columns)).unionByName(created.select(*columns))
    return new_rules, outcome


def backfill_category(rules: DataFrame, spans: DataFrame, default: str = "secret") -> DataFrame:
    """Give every registration the most frequent category of its text (ties by name), or ``default``.

    For tables whose rules have no categories yet: one that is set is replaced.
    """
    text = F.get_json_object("condition_json", "$.filter.pattern.text")
    usual = (
        spans.groupBy(F.col("original_text").alias("_text"), "entity_group")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("_text")
        .agg(F.min(F.struct((-F.col("n")).alias("rank"), "entity_group")).alias("_best"))
    )
    operator = F.col("source") == "approval"
    return (
        rules.withColumn("_keyword", F.when(operator, text))
        .join(usual, F.col("_keyword") == F.col("_text"), "left")
        .withColumn(
            "category",
            F.when(operator, F.coalesce("_best.entity_group", F.lit(default))).otherwise(F.col("category")),
        )
        .select(*rules.columns)
    )

