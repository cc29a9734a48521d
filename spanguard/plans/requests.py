"""Whole request bodies: extract fields, redact them, write them back.  One row per request from start to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanguard.functions.frames import exploded
from spanguard.functions.sqlx import each, each_indexed, empty, hash_chain, keep, let, link, lit, struct
from spanguard.operators.extract import FIELD, _get, _items, apply_replacements, collected_by_format, large_parts, parse_requests
from spanguard.operators.merge import arbitrated, combined
from spanguard.operators.policy import Policy
from spanguard.operators.recognize import Recognizers, builtin_hits
from spanguard.operators.redact import judged
from spanguard.operators.registrations import with_policy_hits
from spanguard.operators.ruletable import RuleTable
from spanguard.operators.scoring import Scorer
from spanguard.plans.pipeline import SPAN_SLOTS
from spanguard.schemas import HIT


def redact_requests(
    requests: DataFrame, policy: Policy | RuleTable, scorer: Scorer | None = None, recognizers: Recognizers | None = None
) -> tuple[DataFrame, DataFrame]:
    """(processed, quarantine).  Input: ``request_id``, ``api_format``, ``body``.

    Adds ``fields``, ``outcomes`` (one per field), ``released``, ``redacted``, ``payload`` and ``rewrite_error``.  A body
    of another format has no fields and passes unchanged; a body that is no JSON object never passes.
    """
    if recognizers is not None and recognizers.extra:
        raise ValueError("requests use the built-in recognizers; run further ones on rows with run_pipeline")
    good, quarantine = parse_requests(requests)
    fields = collected_by_format(good).withColumn("_texts", F.expr("transform(fields, f -> f.text)")).drop("parsed")
    if scorer is None:
        scored = fields.withColumn("_scored", F.expr(each("_texts", lambda t: empty(HIT))))
    else:
        scored = scorer.with_nested_hits(fields, "_texts", "_scored")
    return redact_scored_fields(scored, policy, recognizers), quarantine


def redact_scored_fields(scored: DataFrame, policy: Policy | RuleTable, recognizers: Recognizers | None = None) -> DataFrame:
    """What :func:`redact_requests` adds, from requests with their ``fields``, the texts of these and the scorer's hits on each."""
    policy = policy.narrowed(scored, "_texts", nested=True) if isinstance(policy, RuleTable) else policy
    registered = with_policy_hits(scored, "_texts", "_registered", policy, nested=True)
    closed = (recognizers or Recognizers()).authoritative()

    # One step per column: the analyzer resolves nested lambdas one level per pass, and gives up after a hundred.
    certain = registered.withColumn("_found", F.expr(each("_texts", builtin_hits))).withColumn(
        "_certain", F.expr(each("_found", arbitrated))
    )

    hits = let(
        struct(certain="_certain", scored="_scored", registered="_registered"),
        lambda c: each_indexed(
            f"{c}.certain",
            lambda h, i: f"concat({combined(h, f'{c}.scored[{i}]', closed)}, {c}.registered[{i}])",
        ),
    )
    done = judged(certain.withColumn("_hits", F.expr(hits)), policy, "_texts", "_hits", per="texts").withColumn(
        "outcomes",
        F.expr(
            "transform(arrays_zip(_spans, _redacted), z -> named_struct('spans', z._spans, 'redacted_text', z._redacted))"
        ),
    )
    changes = let(
        struct(fields="fields", outcomes="outcomes"),
        lambda c: keep(
            each_indexed(
                f"{c}.fields",
                lambda f, i: f"if({c}.outcomes[{i}].redacted_text <> {f}.text, named_struct('pointer', {f}.pointer,"
                f" 'text', {c}.outcomes[{i}].redacted_text, 'envelope', {f}.envelope), null)",
            ),
            lambda r: f"{r} is not null",
        ),
    )

    def count_of(action: str) -> Column:
        return F.expr(
            f"aggregate(outcomes, 0, (n, o) -> n + size(filter(o.spans, s -> s.action = {lit(action)})))"
        )

    counted = (
        done.withColumn("replacements", F.expr(f"cast({changes} as array<{FIELD}>)"))
        .withColumn("released", count_of("release"))
        .withColumn("redacted", count_of("redact"))
        .drop("_texts", "_scored", "_registered", "_found", "_certain", "_hits", "_spans", "_ranges", "_redacted")
    )
    return apply_replacements(counted)


def request_pool(processed: DataFrame, created_at: Column, already_audited: Column | None = None) -> DataFrame:
    """Audit rows of processed requests: one per field with spans.

    ``already_audited`` is an ``array<boolean>`` per field (see :func:`audited_fields`); such fields are left out.
    """
    known = F.array().cast("array<boolean>") if already_audited is None else already_audited
    recorded = """transform(outcomes, (o, i) -> named_struct('ordinal', i, 'field', fields[i], 'o', o,
                  'known', coalesce(get(_known, i), false)))"""
    wanted = f"filter({recorded}, r -> size(r.o.spans) > 0 and not r.known)"
    rows = exploded(
        processed.withColumn("_known", known).withColumn("_created", created_at),
        ["request_id", "api_format", "path", "_created"],
        F.expr(wanted),
        "r",
    )
    fragment = F.concat_ws("/", "request_id", "r.ordinal")
    return rows.select(
        fragment.alias("id"),
        "request_id",
        "api_format",
        "path",
        F.unhex(F.sha2("r.field.text", 256)).alias("content_hash"),
        F.col("r.field.text").alias("original_text"),
        F.col("r.o.redacted_text").alias("redacted_text"),
        F.col("_created").cast("bigint").alias("created_at"),
        F.expr(
            f"""transform(r.o.spans, (s, i) -> named_struct(
                'id', concat(request_id, '/', r.ordinal, ':', i), 'entity_group', s.entity_group, 'score', s.score,
                'char_len', char_length(s.original_text), 'byte_start', s.byte_start, 'byte_end', s.byte_end,
                'original_text', s.original_text, 'action', s.action, 'matched_rule_id', s.matched_rule_id,
                'seq', r.ordinal * {SPAN_SLOTS}L + i))"""
        ).alias("spans"),
    )


TURN = "struct<path:string,hash:string,parent_hash:string,fields:array<int>>"


def request_turns(df: DataFrame, roots: dict[str, str]) -> DataFrame:
    """Add ``turns``: the chain of a request's parts, each hash covering the part and everything before it.

    ``roots`` gives the chain root per format (:func:`spanguard.operators.chain.chain_root`).  A part's hash also covers
    where its fields are and what they hold, so a stored result is only found for the same layout.  Parts without
    fields are part of the chain, as is ``/system`` for formats that never read it.  Bodies of any size have the same turns;
    columns ``parsed``, ``body``, ``api_format`` and ``fields`` are read.
    """

    def listed(base: str, key: str) -> str:
        items = f"coalesce({_items(_get('parsed', key))}, cast(array() as array<variant>))"
        return each_indexed(items, lambda v, i: struct(path=f"concat({lit(base)}, {i})", json=f"to_json({v})"))

    def single(path: str, key: str) -> str:
        return struct(path=lit(path), json=f"to_json({_get('parsed', key)})")

    responses = (
        f"concat(array({single('/instructions', 'instructions')}),"
        f" if({_items(_get('parsed', 'input'))} is not null, {listed('/input/', 'input')}, array({single('/input', 'input')})))"
    )
    others = f"concat(array({single('/system', 'system')}), {listed('/messages/', 'messages')})"
    small = keep(f"if(api_format = 'openai_responses', {responses}, {others})", lambda p: f"{p}.json is not null")
    # Each part of a body that no VARIANT holds is written as it would be in a smaller body, if a VARIANT can hold the part.
    large = each("_parts", lambda p: struct(path=f"{p}.path", json=f"coalesce(to_json(try_parse_json({p}.json)), {p}.json)"))
    parts = f"if(parsed is null, {large}, {small})"

    def digest(p: str) -> str:
        mine = keep(
            each_indexed("fields", lambda f, i: struct(i=i, pointer=f"{f}.pointer", text=f"{f}.text")),
            lambda f: f"({f}.pointer = {p}.path or startswith({f}.pointer, concat({p}.path, '/')))",
        )

        def body(own: str) -> str:
            layout = each(
                own,
                lambda f: f"to_json(array(substring({f}.pointer, char_length({p}.path) + 1), {f}.text))",
            )
            return struct(
                path=f"{p}.path",
                digest=f"sha2(concat({p}.json, chr(31), array_join({layout}, chr(31))), 256)",
                fields=each(own, lambda f: f"{f}.i"),
            )

        return let(mine, body)

    root = "case api_format " + " ".join(f"when {lit(k)} then {lit(v)}" for k, v in roots.items()) + " end"
    def linked(p: str) -> str:
        return let(
            f"cast({hash_chain(each(p, lambda x: f'{x}.digest'), root)} as binary)",
            lambda c: each_indexed(
                p,
                lambda x, i: struct(
                    path=f"{x}.path",
                    hash=link(c, i),
                    parent_hash=f"if({i} = 0, {root}, {link(c, f'({i} - 1)')})",
                    fields=f"{x}.fields",
                ),
            ),
        )

    chained = f"cast({let(each(parts, digest), linked)} as array<{TURN}>)"
    cut = df.withColumn("_parts", large_parts(F.when(F.col("parsed").isNull(), F.col("body")), F.col("api_format")))
    return cut.withColumn("turns", F.expr(chained)).drop("_parts")


def audited_fields(requests: DataFrame, nodes: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request the ordinals of fields whose part is stored already: columns ``key`` and ``audited`` (array<int>).

    Only hashes travel; a request is bounded, and so is its list of ordinals.
    """
    parts = exploded(requests, [key], "turns", "t").select(key, "t.hash", "t.fields")
    found = parts.join(nodes.select("hash").distinct(), "hash", "left_semi")
    return found.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("fields"))).alias("audited"))
