"""Rules: condition trees compiled to one expression, the built-in policy, validation, registrations.

A policy is small and known on the driver, so its rules become SQL text that Catalyst folds into the plan.  Rules that
are a single exact keyword (operator decisions are) do not get a branch each: they go into one hash-tested lookup.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanguard.functions.offsets import WHITE_SPACE
from spanguard.functions.sqlx import let, lit, struct
from spanguard.schemas import ACTIONS, CATEGORIES, FALLBACK_PRIORITY, RULE_SCHEMA, SOURCES

# Priority layers.
DEFAULT_REDACT, RELEASE_NOISE, RELEASE_KEYWORD, FORCE_REDACT = 100, 400, 500, 1000
# Built-in thresholds; a hit must be longer than this.  Dates have no built-in rule.
MIN_CONFIDENCE = 0.8
LONGER_THAN = {
    "account_number": 3,
    "private_address": 4,
    "private_person": 4,
    "private_phone": 6,
    "private_url": 4,
    "secret": 7,
}
NO_BUILTIN_RULE = ("private_date",)

_COMPARE = {"greater": ">", "equal": "=", "less": "<"}


class PolicyError(ValueError):
    """A rule that must not be used."""


@dataclass(frozen=True)
class Rule:
    id: str
    priority: int
    condition: dict[str, Any]
    action: str
    name: str = ""
    enabled: bool = True
    source: str = "console"
    category: str | None = None


def entity(group: str) -> dict:
    return {"kind": "filter", "filter": {"kind": "entity", "group": group}}


def keyword(text: str, kind: str = "exact", case_sensitive: bool = False) -> dict:
    pattern = {"text": text, "kind": kind, "case_sensitive": case_sensitive}
    return {"kind": "filter", "filter": {"kind": "keyword", "pattern": pattern}}


def character_length(operator: str, value: int) -> dict:
    return {"kind": "filter", "filter": {"kind": "character_length", "operator": operator, "value": value}}


def confidence(operator: str, value: float) -> dict:
    return {"kind": "filter", "filter": {"kind": "confidence", "operator": operator, "value": value}}


def all_of(*conditions: dict) -> dict:
    return {"kind": "all", "conditions": list(conditions)}


def any_of(*conditions: dict) -> dict:
    return {"kind": "any", "conditions": list(conditions)}


def operator_rule(rule_id: str, action: str, text: str, category: str) -> Rule:
    """A person's decision on one exact text."""
    return Rule(rule_id, decision_priority(action), keyword(text), action, f"approval.{action}", True, "approval", category)


def decision_priority(action: str) -> int:
    return FORCE_REDACT if action == "redact" else RELEASE_KEYWORD


# ---------------------------------------------------------------------------------------------------------------
# Condition trees
# ---------------------------------------------------------------------------------------------------------------


def glob_pattern(text: str) -> str:
    """Java pattern of a glob: ``*`` any text, ``?`` one character, all else literal.

    The pieces between stars are matched one after the other, each at its leftmost place and never again (a piece has
    a fixed length, so the leftmost place leaves most to the rest); only the last piece is held to the end.
    """

    def piece(part: str) -> str:
        return "".join("." if c == "?" else c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in part)

    first, *rest = text.split("*")
    if not rest:
        return f"(?s)^{piece(first)}\\z"
    *inner, last = rest
    middle = "".join(f"(?>.*?{piece(part)})" for part in inner if part)
    # What is left must end in the last piece: look from the end, without trying other places for the pieces before.
    tail = f"(?>.*)(?<={piece(last)})\\z" if last else ""
    room = f"(?=.{{{len(last)}}})" if last else ""
    return f"(?s)^(?>{piece(first)}{middle}){room}{tail}"


def condition_sql(node: dict, group: str, score: str, word: str) -> str:
    """SQL boolean of a condition tree over one span."""
    kind = node["kind"]
    if kind in ("all", "any"):
        parts = [condition_sql(child, group, score, word) for child in node["conditions"]]
        if not parts:
            return lit(kind == "all")
        return "(" + (" and " if kind == "all" else " or ").join(parts) + ")"
    test = node["filter"]
    match test["kind"]:
        case "entity":
            return f"{group} = {lit(test['group'])}"
        case "character_length":
            return f"char_length({word}) {_COMPARE[test['operator']]} {int(test['value'])}"
        case "confidence":
            return f"{score} {_COMPARE[test['operator']]} {lit(float(test['value']))}"
        case "keyword":
            pattern = test["pattern"]
            text, needle = word, lit(pattern["text"])
            if not pattern["case_sensitive"]:
                text, needle = f"lower({word})", f"lower({needle})"
            match pattern["kind"]:
                case "exact":
                    return f"{text} = {needle}"
                case "substring":
                    return f"contains({text}, {needle})"
                case "glob":
                    glob = pattern["text"] if pattern["case_sensitive"] else pattern["text"].lower()
                    return f"{text} rlike {lit(glob_pattern(glob))}"
    raise PolicyError(f"unknown condition {node!r}")


def matches(node: dict, group: str = "entity_group", score: str = "score", word: str = "word") -> Column:
    """A condition tree as a Column over columns with these names."""
    return F.expr(condition_sql(node, group, score, word))


def exact_keyword(node: dict) -> dict | None:
    """The first exact-keyword pattern in a tree; it is the identity of a registration."""
    if node["kind"] in ("all", "any"):
        return next(filter(None, map(exact_keyword, node["conditions"])), None)
    test = node["filter"]
    if test["kind"] == "keyword" and test["pattern"]["kind"] == "exact":
        return test["pattern"]
    return None


def _filters(node: dict) -> Iterable[dict]:
    if node["kind"] in ("all", "any"):
        for child in node["conditions"]:
            yield from _filters(child)
    else:
        yield node["filter"]


def violations(rule: Rule) -> list[str]:
    """Why a rule must not be used; empty if it may."""
    found = []
    if not rule.id.strip(WHITE_SPACE):
        found.append("empty_rule_id")
    if rule.source == "approval" and rule.category is None:
        found.append("missing_category")
    for test in _filters(rule.condition):
        if test["kind"] == "keyword" and not test["pattern"]["text"].strip(WHITE_SPACE):
            found.append("empty_pattern")
        if test["kind"] == "confidence":
            value = float(test["value"])
            if not math.isfinite(value) or not 0.0 <= value <= 1.0:
                found.append("invalid_confidence")
    if rule.action not in ACTIONS:
        found.append("unknown_action")
    if rule.source not in SOURCES:
        found.append("unknown_source")
    return found


# ---------------------------------------------------------------------------------------------------------------
# Policy
# ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Registration:
    """A text that is a hit wherever it occurs."""

    text: str
    group: str
    case_sensitive: bool


@dataclass(frozen=True)
class Policy:
    """Rules in order of (priority descending, id), and what happens to a span that none of them claims."""

    rules: tuple[Rule, ...]
    fallback: str = "release"

    def __post_init__(self):
        for rule in self.rules:
            problems = violations(rule)
            if problems:
                raise PolicyError(f"rule {rule.id!r}: {', '.join(problems)}")
        ordered = tuple(sorted(self.rules, key=lambda r: (-r.priority, r.id)))
        object.__setattr__(self, "rules", ordered)

    def with_fallback(self, action: str) -> Policy:
        return replace(self, fallback=action)

    def with_rules(self, *rules: Rule) -> Policy:
        return replace(self, rules=self.rules + rules)

    def registrations(self) -> list[Registration]:
        """Enabled operator decisions: their text is a hit wherever it occurs."""
        return [
            Registration(pattern["text"], rule.category, pattern["case_sensitive"])
            for rule in self.rules
            if rule.enabled and rule.source == "approval" and rule.category
            if (pattern := exact_keyword(rule.condition))
        ]

    def registered_texts(self) -> list[str]:
        """Texts a person has decided on, whether or not the rule is still enabled."""
        patterns = (exact_keyword(rule.condition) for rule in self.rules if rule.source == "approval")
        return list(dict.fromkeys(p["text"] for p in patterns if p))

    def _rank_sql(self, group: str, score: str, word: str) -> str:
        """SQL: index of the first enabled rule that matches, null if none does."""
        branches, folded, sensitive = [], {}, {}
        for rank, rule in enumerate(self.rules):
            if not rule.enabled:
                continue
            node = rule.condition
            pattern = exact_keyword(node) if node["kind"] == "filter" else None
            if pattern and pattern["case_sensitive"]:
                sensitive.setdefault(pattern["text"], rank)
            elif pattern:
                folded.setdefault(pattern["text"], rank)
            else:
                branches.append(f"when {condition_sql(node, group, score, word)} then {rank}")
        options = []
        if branches:
            options.append(f"case {' '.join(branches)} end")
        if sensitive:
            options.append(_lookup(word, {lit(text): rank for text, rank in sensitive.items()}))
        if folded:
            options.append(_lookup(f"lower({word})", {f"lower({lit(text)})": rank for text, rank in folded.items()}))
        if not options:
            return "cast(null as int)"
        return options[0] if len(options) == 1 else f"least({', '.join(options)})"

    def decision_sql(self, group: str, score: str, word: str) -> str:
        """SQL struct(action, rule_id, priority) of the first matching rule."""
        fallback = struct(action=lit(self.fallback), rule_id="cast(null as string)", priority=str(FALLBACK_PRIORITY))
        if not self.rules:
            return fallback
        ids = f"array({', '.join(lit(r.id) for r in self.rules)})"
        actions = f"array({', '.join(lit(r.action) for r in self.rules)})"
        priorities = f"array({', '.join(str(r.priority) for r in self.rules)})"

        def decided(rank: str) -> str:
            return struct(
                action=f"coalesce(get({actions}, {rank}), {lit(self.fallback)})",
                rule_id=f"get({ids}, {rank})",
                priority=f"coalesce(get({priorities}, {rank}), {FALLBACK_PRIORITY})",
            )

        return let(self._rank_sql(group, score, word), decided)

    def registered_sql(self, word: str) -> str:
        """SQL boolean: some operator decision, enabled or not, is about this text."""
        patterns = [p for r in self.rules if r.source == "approval" and (p := exact_keyword(r.condition))]
        sensitive = [lit(p["text"]) for p in patterns if p["case_sensitive"]]
        folded = [f"lower({lit(p['text'])})" for p in patterns if not p["case_sensitive"]]
        tests = []
        if sensitive:
            tests.append(f"{word} in ({', '.join(sensitive)})")
        if folded:
            tests.append(f"lower({word}) in ({', '.join(folded)})")
        return f"({' or '.join(tests)})" if tests else "false"


def _lookup(key: str, ranks: dict[str, int]) -> str:
    keys = ", ".join(ranks)
    # Two texts may fold to one key; the earlier rule keeps it.
    return (
        f"if({key} in ({keys}), array_min(transform(filter(array("
        + ", ".join(struct(k=k, r=str(r)) for k, r in ranks.items())
        + f"), e -> e.k = {key}), e -> e.r)), null)"
    )


def evaluate(spans: DataFrame, policy: Policy, group="entity_group", score="score", word="word") -> DataFrame:
    """Add ``action``, ``matched_rule_id`` and ``priority`` to span rows."""
    return (
        spans.withColumn("_decision", F.expr(policy.decision_sql(f"`{group}`", f"`{score}`", f"`{word}`")))
        .withColumn("action", F.col("_decision.action"))
        .withColumn("matched_rule_id", F.col("_decision.rule_id"))
        .withColumn("priority", F.col("_decision.priority"))
        .drop("_decision")
    )


def builtin_policy(recognizers=None) -> Policy:
    """Twelve rules: a protected category, confident enough unless its hits are certain, and long enough."""
    kinds = {name: kind for name, _, kind in CATEGORIES}
    kind_of = kinds.get if recognizers is None else recognizers.kind_of
    rules = []
    for group, _, _ in CATEGORIES:
        if group in NO_BUILTIN_RULE:
            continue
        conditions = [entity(group)]
        if kind_of(group) != "authoritative":
            conditions.append(confidence("greater", MIN_CONFIDENCE))
        if group in LONGER_THAN:
            conditions.append(character_length("greater", LONGER_THAN[group]))
        name = f"builtin.redact.{group}"
        rules.append(Rule(name, DEFAULT_REDACT, all_of(*conditions), "redact", name, True, "builtin"))
    return Policy(tuple(rules))


# ---------------------------------------------------------------------------------------------------------------
# Rules as tables
# ---------------------------------------------------------------------------------------------------------------


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [
        (r.id, r.name or r.id, r.priority, json.dumps(r.condition, ensure_ascii=False), r.action, r.enabled, r.source, r.category)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def load_policy(rules: DataFrame, fallback: str = "release", most: int = 10_000) -> Policy:
    """Compile a rules table.  Rules are edited by people; more than ``most`` of them is an error, not a silent cut.

    Larger registration tables are evaluated with :func:`evaluate_registered` instead.
    """
    rows = rules.orderBy(F.desc("priority"), "id").limit(most + 1).collect()
    if len(rows) > most:
        raise PolicyError(f"more than {most} rules; join them with evaluate_registered")
    return Policy(
        tuple(
            Rule(r.id, r.priority, json.loads(r.condition_json), r.action, r.name, r.enabled, r.source, r.category)
            for r in rows
        ),
        fallback,
    )


def rule_violations(rules: DataFrame) -> DataFrame:
    """One row (id, violation) per broken rule, found on the executors.

    A condition that is no JSON, or holds an unknown or incomplete condition, is ``invalid_condition``.
    """

    def problems(r) -> list[str]:
        try:
            condition = json.loads(r.condition_json)
            condition_sql(condition, "g", "s", "w")
        except (KeyError, TypeError, ValueError, AttributeError):
            return ["invalid_condition"]
        return violations(Rule(r.id or "", r.priority, condition, r.action, r.name, r.enabled, r.source, r.category))

    def check(batches):
        for batch in batches:
            found = [(r.id, problem) for r in batch.itertuples() for problem in problems(r)]
            yield pd.DataFrame(found, columns=["id", "violation"])

    return rules.mapInPandas(check, "id string, violation string")


def keyword_rules(rules: DataFrame, nested: bool = False) -> DataFrame:
    """Rules that are one exact keyword, with ``keyword`` and ``case_sensitive`` taken from the condition.

    With ``nested`` also operator decisions whose first exact keyword stands inside a larger condition: it is the
    identity of the registration, as it is in a compiled policy.
    """
    pattern = "$.filter.pattern"
    found = F.when(
        F.get_json_object("condition_json", f"{pattern}.kind") == "exact",
        F.struct(
            F.get_json_object("condition_json", f"{pattern}.text").alias("text"),
            F.get_json_object("condition_json", f"{pattern}.case_sensitive").cast("boolean").alias("case_sensitive"),
        ),
    )
    if nested:

        @F.pandas_udf("struct<text:string,case_sensitive:boolean>")
        def first_keyword(conditions: pd.Series) -> pd.DataFrame:
            patterns = [exact_keyword(json.loads(c)) if c else None for c in conditions]
            return pd.DataFrame([(p["text"], p["case_sensitive"]) if p else (None, None) for p in patterns], columns=["text", "case_sensitive"])

        tree = (F.col("source") == "approval") & ~F.coalesce(F.get_json_object("condition_json", "$.kind") == "filter", F.lit(False))
        found = F.coalesce(found, first_keyword(F.when(tree, F.col("condition_json"))))
    return (
        rules.withColumn("_pattern", found)
        .withColumn("keyword", F.col("_pattern.text"))
        .withColumn("case_sensitive", F.col("_pattern.case_sensitive"))
        .drop("_pattern")
        .where(F.col("keyword").isNotNull())
    )


def operator_decision(texts: DataFrame, rules: DataFrame, text: str = "original_text") -> DataFrame:
    """The registration that counts for each text: highest priority, then id; enabled or not.

    Equi-joins on the text and on the folded text; rules are reduced to one per key before the join, so a text that a
    third of all rows hold meets a single rule row.
    """
    operator = keyword_rules(rules, nested=True).where(F.col("source") == "approval")
    best = F.min(F.struct((-F.col("priority")).alias("rank"), "id", "action", "category"))
    sensitive = operator.where("case_sensitive").groupBy("keyword").agg(best.alias("_exact"))
    folded = (
        operator.where("not case_sensitive").groupBy(F.lower("keyword").alias("_key")).agg(best.alias("_folded"))
    )
    joined = (
        texts.join(sensitive, texts[text] == sensitive["keyword"], "left")
        .drop("keyword")
        .withColumn("_fold", F.lower(F.col(text)))
        .join(folded, F.col("_fold") == F.col("_key"), "left")
    )
    return (
        joined.withColumn("_best", F.least("_exact", "_folded"))
        .withColumn("registered_action", F.col("_best.action"))
        .withColumn("registered_rule_id", F.col("_best.id"))
        .drop("_exact", "_folded", "_best", "_fold", "_key")
    )


def evaluate_registered(spans: DataFrame, rules: DataFrame, policy: Policy, word: str = "word") -> DataFrame:
    """Large-table form of :func:`evaluate`: exact-keyword rules come from a table, all others from ``policy``."""
    enabled = keyword_rules(rules).where("enabled")
    best = F.min(F.struct((-F.col("priority")).alias("rank"), "id", "action"))
    sensitive = enabled.where("case_sensitive").groupBy("keyword").agg(best.alias("_exact"))
    folded = enabled.where("not case_sensitive").groupBy(F.lower("keyword").alias("_key")).agg(best.alias("_folded"))
    decided = evaluate(spans, policy, word=word)
    compiled = F.when(
        F.col("matched_rule_id").isNotNull(),
        F.struct(
            (-F.col("priority")).alias("rank"), F.col("matched_rule_id").alias("id"), F.col("action").alias("action")
        ),
    )
    return (
        decided.join(sensitive, decided[word] == sensitive["keyword"], "left")
        .drop("keyword")
        .withColumn("_fold", F.lower(F.col(word)))
        .join(folded, F.col("_fold") == F.col("_key"), "left")
        .withColumn("_best", F.least("_exact", "_folded", compiled))
        .withColumn("action", F.coalesce("_best.action", F.lit(policy.fallback)))
        .withColumn("matched_rule_id", F.col("_best.id"))
        .withColumn("priority", F.coalesce(-F.col("_best.rank"), F.lit(FALLBACK_PRIORITY)))
        .drop("_exact", "_folded", "_best", "_fold", "_key")
    )

