"""Text fields of request bodies, and writing replaced texts back.

Bodies are parsed once into VARIANT; the fields of one body are an array in its row, so extraction, redaction and
write-back of a request need no shuffle.
"""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanguard.functions.frames import exploded, with_rows_where
from spanguard.functions.sqlx import each, each_indexed, empty, keep, let, lit, struct

FIELD = "struct<pointer:string,text:string,envelope:string>"

# Request path to body format.
FORMAT_OF_PATH = {
    "/v1/responses": "openai_responses",
    "/v1/chat/completions": "openai_chat",
    "/v1/messages": "anthropic_messages",
}

# The status block that a script tool writes before its output (three lines, a decimal number).
_NUMBER = r"[+-]?(?:(?i:inf(?:inity)?|nan)|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
STATUS_BLOCK = rf"^Script completed\r?\nWall time {_NUMBER} seconds\r?\nOutput:(?:\r?\n)?\z"


def format_of(path: str = "path") -> Column:
    """Body format of a request path; null for paths that are passed through."""
    column = F.lit(None).cast("string")
    for known, name in FORMAT_OF_PATH.items():
        column = F.when(F.col(path) == known, F.lit(name)).otherwise(column)
    return column


def is_model_output(role: str, kind: str) -> str:
    """SQL: the item was written by the model itself.  Without a role the type decides; without both it is scanned."""
    return (
        f"coalesce(if({role} is not null, {role} = 'assistant',"
        f" endswith({kind}, '_call') or {kind} = 'reasoning'), false)"
    )


def scannable_turns(turns: DataFrame, role: str = "role") -> DataFrame:
    """Turns that did not come from the model."""
    return turns.where(F.coalesce(F.col(role) != "assistant", F.lit(True)))


# ---------------------------------------------------------------------------------------------------------------
# VARIANT helpers (SQL text)
# ---------------------------------------------------------------------------------------------------------------


def _get(v: str, path: str) -> str:
    return f"try_variant_get({v}, '$.{path}', 'variant')"


def _items(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<variant>')"


def _string(v: str) -> str:
    """The text of a JSON string; null for any other kind of value."""
    return f"if(schema_of_variant({v}) = 'STRING', cast({v} as string), null)"


def _is_number(v: str) -> str:
    return f"coalesce(schema_of_variant({v}) rlike '^(BIGINT|DOUBLE|FLOAT|DECIMAL)', false)"


def strict_json(text: str) -> str:
    """SQL: the text as VARIANT, null unless it is exactly one JSON value.

    Spark's parser stops after the first value and ignores what follows.  Inside an object inside an array, nothing can
    follow the value without breaking one of them, or showing up as a second key or item.
    """

    def alone(w: str) -> str:
        keys = f"map_keys(cast(try_variant_get({w}, '$[0]', 'variant') as map<string, variant>))"
        return (
            f"if(size({_items(w)}) = 1 and size({keys}) = 1,"
            f" try_variant_get({w}, '$[0].v', 'variant'), null)"
        )

    wrapped = f"try_parse_json(concat({lit('[{' + chr(34) + 'v' + chr(34) + ':')}, {text}, {lit('}]')}))"
    return let(wrapped, lambda w: f"if({w} is null, null, {alone(w)})")


def _field(pointer: str, text: str) -> str:
    return f"named_struct('pointer', {pointer}, 'text', {text}, 'envelope', cast(null as string))"


def text_or_blocks(v: str, pointer: str) -> str:
    """SQL array<FIELD>: the string itself, or the ``text`` of each block of an array."""

    def blocks(items: str) -> str:
        def one(item: str, i: str) -> str:
            place = f"concat({pointer}, '/', {i}, '/text')"
            return let(_string(_get(item, "text")), lambda t: f"if({t} is null, null, {_field(place, t)})")

        return each_indexed(items, one)

    def either(value: str) -> str:
        return let(
            _items(value),
            lambda items: f"if({items} is not null, array_compact({blocks(items)}),"
            + let(_string(value), lambda t: f"if({t} is null, {empty(FIELD)}, array({_field(pointer, t)}))")
            + ")",
        )

    return f"cast({let(v, lambda x: f'if({x} is null, {empty(FIELD)}, {either(x)})')} as array<{FIELD}>)"


def unpacked(fields: str) -> str:
    """SQL: output of a script tool: take the text out of its JSON envelope, drop status blocks and empty texts."""

    def one(f: str) -> str:
        return let(
            strict_json(f"{f}.text"),
            lambda v: let(
                f"if({v} is not null and {_string(_get(v, 'chunk_id'))} is not null"
                f" and {_is_number(_get(v, 'wall_time_seconds'))}, {_string(_get(v, 'output'))}, null)",
                lambda t: f"if({t} is null, {f}, named_struct('pointer', {f}.pointer, 'text', {t}, 'envelope', {f}.text))",
            ),
        )

    return keep(
        f"cast({each(fields, one)} as array<{FIELD}>)",
        lambda f: f"{f}.text <> '' and not ({f}.envelope is null and {f}.text rlike {lit(STATUS_BLOCK)})",
    )


def _scanned(items: str, per_item) -> str:
    """SQL: fields of all items that the model did not write, in order."""

    def one(item: str, i: str) -> str:
        return let(
            struct(role=_string(_get(item, "role")), kind=_string(_get(item, "type"))),
            lambda m: f"if({is_model_output(f'{m}.role', f'{m}.kind')}, {empty(FIELD)}, {per_item(item, i)})",
        )

    return f"flatten({each_indexed(items, one)})"


def responses_fields(body: str) -> str:
    """``/instructions``, ``/input`` as text or with a direct ``text`` per item, then content and output of each item.

    The direct ``text`` is taken before items of the model are left out, so it is scanned in those as well.
    """

    def item_fields(items: str, calls: str):
        def per_item(item: str, i: str) -> str:
            base = f"concat('/input/', {i})"
            output = text_or_blocks(_get(item, "output"), f"concat({base}, '/output')")
            from_script = (
                f"coalesce({_string(_get(item, 'type'))} = 'custom_tool_call_output'"
                f" and array_contains({calls}, {_string(_get(item, 'call_id'))}), false)"
            )
            direct = let(_string(item), lambda t: f"if({t} is null, {empty(FIELD)}, array({_field(base, t)}))")
            content = text_or_blocks(_get(item, "content"), f"concat({base}, '/content')")
            unwrapped = let(output, lambda o: f"if({from_script}, {unpacked(o)}, {o})")
            return f"concat({direct}, {content}, {unwrapped})"

        return per_item

    def script_calls(items: str) -> str:
        def is_script(item: str) -> str:
            return (
                f"coalesce({_string(_get(item, 'type'))} = 'custom_tool_call'"
                f" and {_string(_get(item, 'name'))} = 'exec', false)"
            )

        ids = each(keep(items, is_script), lambda item: _string(_get(item, "call_id")))
        return f"array_compact({ids})"

    items = let(
        _items(_get(body, "input")),
        lambda xs: f"if({xs} is null, {empty(FIELD)}, "
        + let(script_calls(xs), lambda calls: _scanned(xs, item_fields(xs, calls)))
        + ")",
    )
    return (
        f"concat({text_or_blocks(_get(body, 'instructions'), lit('/instructions'))},"
        f" {text_or_blocks(_get(body, 'input'), lit('/input'))}, {items})"
    )


def chat_fields(body: str) -> str:
    """Content of every message that the model did not write."""
    return _message_fields(body, nested=False)


def messages_fields(body: str) -> str:
    """``/system``, content of messages, and content nested in content blocks (tool results)."""
    return f"concat({text_or_blocks(_get(body, 'system'), lit('/system'))}, {_message_fields(body, nested=True)})"


def _message_fields(body: str, nested: bool) -> str:
    def per_message(message: str, i: str) -> str:
        base = f"concat('/messages/', {i}, '/content')"
        own = text_or_blocks(_get(message, "content"), base)
        if not nested:
            return own

        def inner(blocks: str) -> str:
            return "flatten(" + each_indexed(
                blocks, lambda b, j: text_or_blocks(_get(b, "content"), f"concat({base}, '/', {j}, '/content')")
            ) + ")"

        deeper = let(
            _items(_get(message, "content")), lambda xs: f"if({xs} is null, {empty(FIELD)}, {inner(xs)})"
        )
        return f"concat({own}, {deeper})"

    return let(
        _items(_get(body, "messages")), lambda xs: f"if({xs} is null, {empty(FIELD)}, {_scanned(xs, per_message)})"
    )


_COLLECTORS = {
    "openai_responses": responses_fields,
    "openai_chat": chat_fields,
    "anthropic_messages": messages_fields,
}


def rewritten_json(text: Column) -> Column:
    """A text that is exactly one JSON value, written anew: of repeated keys the last one counts.  Null for anything else."""

    def plain(value: str | None) -> str | None:
        try:
            return None if value is None else json.dumps(json.loads(value, parse_constant=_no_number), allow_nan=False)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def rewritten(values: pd.Series) -> pd.Series:
        return values.map(plain, na_action="ignore")

    return rewritten(text)


def _no_number(name: str):
    raise ValueError(name)


def parse_requests(requests: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(good requests with a ``parsed`` VARIANT, quarantine): a body must be a JSON object.

    The built-in parser refuses repeated keys; what it refuses is looked at again, and of repeated keys the last one counts.
    A JSON object larger than a VARIANT can be stays among the good ones with a null ``parsed``; :func:`collected_by_format`
    reads its fields from the body.
    """
    first = requests.withColumn("_first", F.expr(strict_json(f"`{body}`")))
    again = first.withColumn("_again", rewritten_json(F.when(F.col("_first").isNull(), F.col(body))))
    parsed = again.withColumn("parsed", F.expr(f"coalesce(_first, {strict_json('_again')})"))
    is_json = F.col("parsed").isNotNull() | F.col("_again").isNotNull()
    # A JSON text is an object if it parses and its first character after blanks is a brace.
    is_object = F.coalesce(is_json & F.col(body).rlike(r"^[ \t\r\n]*\{"), F.lit(False))
    reason = F.when(~is_json, "not_json").otherwise("not_an_object")
    good = with_rows_where(parsed, is_object).drop("_first", "_again")
    return good, with_rows_where(parsed.withColumn("reject_reason", reason), ~is_object).drop("parsed", "_first", "_again")


# ---------------------------------------------------------------------------------------------------------------
# The same fields from bodies that no VARIANT can hold
# ---------------------------------------------------------------------------------------------------------------


def _plain_text_or_blocks(value, pointer: str) -> list[tuple]:
    if isinstance(value, str):
        return [(pointer, value, None)]
    blocks = enumerate(value if isinstance(value, list) else ())
    return [(f"{pointer}/{i}/text", b["text"], None) for i, b in blocks if isinstance(b, dict) and isinstance(b.get("text"), str)]


def _unrepeated(pairs: list[tuple]) -> dict:
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("repeated key")
    return found


def _plain_unpacked(fields: list[tuple]) -> list[tuple]:
    out = []
    for pointer, text, envelope in fields:
        try:
            v = json.loads(text, parse_constant=_no_number, object_pairs_hook=_unrepeated)
        except (ValueError, RecursionError):
            v = None
        if isinstance(v, dict) and isinstance(v.get("chunk_id"), str) and isinstance(v.get("output"), str):
            number = v.get("wall_time_seconds")
            if isinstance(number, (int, float)) and not isinstance(number, bool):
                text, envelope = v["output"], text
        if text and not (envelope is None and re.search(STATUS_BLOCK.replace(r"\z", r"\Z"), text)):
            out.append((pointer, text, envelope))
    return out


def _plain_scanned(items):
    for i, item in enumerate(items if isinstance(items, list) else ()):
        own = item if isinstance(item, dict) else {}
        role, kind = own.get("role"), own.get("type")
        if role == "assistant" if isinstance(role, str) else isinstance(kind, str) and (kind.endswith("_call") or kind == "reasoning"):
            continue
        yield i, item, own


def plain_fields(body: str, api_format: str | None) -> list[tuple]:
    """(pointer, text, envelope) of a body that is a JSON object: what :data:`_COLLECTORS` find in its VARIANT."""
    if api_format not in _COLLECTORS:
        return []
    document, out = json.loads(body), []
    if api_format == "openai_responses":
        given = document.get("input")
        out += _plain_text_or_blocks(document.get("instructions"), "/instructions") + _plain_text_or_blocks(given, "/input")
        listed = [x for x in (given if isinstance(given, list) else ()) if isinstance(x, dict)]
        calls = {x["call_id"] for x in listed if x.get("type") == "custom_tool_call" and x.get("name") == "exec" and isinstance(x.get("call_id"), str)}
        for i, item, own in _plain_scanned(given):
            out += [(f"/input/{i}", item, None)] if isinstance(item, str) else []
            out += _plain_text_or_blocks(own.get("content"), f"/input/{i}/content")
            output, call = _plain_text_or_blocks(own.get("output"), f"/input/{i}/output"), own.get("call_id")
            scripted = own.get("type") == "custom_tool_call_output" and isinstance(call, str) and call in calls
            out += _plain_unpacked(output) if scripted else output
        return out
    nested = api_format == "anthropic_messages"
    if nested:
        out += _plain_text_or_blocks(document.get("system"), "/system")
    for i, _, own in _plain_scanned(document.get("messages")):
        content, base = own.get("content"), f"/messages/{i}/content"
        out += _plain_text_or_blocks(content, base)
        for j, block in enumerate(content if nested and isinstance(content, list) else ()):
            out += _plain_text_or_blocks(block.get("content") if isinstance(block, dict) else None, f"{base}/{j}/content")
    return out


_FIELDS = pa.list_(pa.struct([(n, pa.string()) for n in ("pointer", "text", "envelope")]))


def _large_fields(body: Column, api_format: Column) -> Column:
    """``array<FIELD>`` of each body; null bodies have none."""

    @F.arrow_udf(f"array<{FIELD}>")
    def fields(bodies: pa.Array, formats: pa.Array) -> pa.Array:
        def clean(text):
            return text and text.encode("utf-8", "replace").decode()

        rows = (plain_fields(b.as_py(), f.as_py()) if b.is_valid else [] for b, f in zip(bodies, formats))
        return pa.array([[{"pointer": p, "text": clean(t), "envelope": clean(e)} for p, t, e in row] for row in rows], _FIELDS)

    return fields(body, api_format)


_PARTS = pa.list_(pa.struct([("path", pa.string()), ("json", pa.string())]))


def large_parts(body: Column, api_format: Column) -> Column:
    """``array<struct<path, json>>``: the parts of each body that make its turns, as JSON texts; none of null bodies."""

    def cut(text: str | None, kind: str | None) -> list[dict]:
        document = json.loads(text) if text is not None else {}
        if not isinstance(document, dict):
            return []
        head, rest = ("instructions", "input") if kind == "openai_responses" else ("system", "messages")
        listed = document.get(rest)
        values = [(f"/{head}", document[head])] if head in document else []
        if isinstance(listed, list):
            values += [(f"/{rest}/{i}", value) for i, value in enumerate(listed)]
        elif rest == "input" and rest in document:
            values.append((f"/{rest}", listed))
        return [{"path": path, "json": json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace").decode()} for path, value in values]

    @F.arrow_udf("array<struct<path:string,json:string>>")
    def parts(bodies: pa.Array, formats: pa.Array) -> pa.Array:
        return pa.array([cut(b.as_py(), f.as_py()) for b, f in zip(bodies, formats)], _PARTS)

    return parts(body, api_format)


def _with_large(df: DataFrame, sql: str, api_format: Column, parsed: str, output: str, body: str) -> DataFrame:
    if body not in df.columns:
        return df.withColumn(output, F.expr(sql))
    large = _large_fields(F.when(F.col(parsed).isNull(), F.col(body)), api_format)
    return df.withColumn("_large", large).withColumn(output, F.when(F.col(parsed).isNull(), F.col("_large")).otherwise(F.expr(sql))).drop("_large")


def collected(df: DataFrame, api_format: str, parsed: str = "parsed", output: str = "fields", body: str = "body") -> DataFrame:
    """Add the fields of bodies of one format as ``array<FIELD>``, in write-back order."""
    sql = f"cast({_COLLECTORS[api_format](f'`{parsed}`')} as array<{FIELD}>)"
    return _with_large(df, sql, F.lit(api_format), parsed, output, body)


def collected_by_format(
    df: DataFrame, api_format: str = "api_format", parsed: str = "parsed", output: str = "fields", body: str = "body"
) -> DataFrame:
    """Add the fields of every body by the format in its row; other formats have none."""
    branches = " ".join(
        f"when `{api_format}` = {lit(name)} then cast({collect(f'`{parsed}`')} as array<{FIELD}>)"
        for name, collect in _COLLECTORS.items()
    )
    return _with_large(df, f"case {branches} else {empty(FIELD)} end", F.col(api_format), parsed, output, body)


def field_rows(df: DataFrame, kept: list[str], fields: str = "fields") -> DataFrame:
    """One row per field with its ordinal."""
    numbered = F.expr(
        f"transform(`{fields}`, (f, i) -> named_struct('ordinal', i, 'pointer', f.pointer, 'text', f.text,"
        " 'envelope', f.envelope))"
    )
    return exploded(df, kept, numbered, "f").select(*kept, "f.*")


# ---------------------------------------------------------------------------------------------------------------
# Write-back
# ---------------------------------------------------------------------------------------------------------------


def _set_pointer(document, pointer: str, text: str) -> bool:
    parent, target = None, document
    for token in pointer.split("/")[1:]:
        key = token.replace("~1", "/").replace("~0", "~")
        parent = target
        if isinstance(target, list):
            if not key.isdigit() or (len(key) > 1 and key[0] == "0") or int(key) >= len(target):
                return False
            key = int(key)
        elif not isinstance(target, dict) or key not in target:
            return False
        target = target[key]
    if parent is None or not isinstance(target, str):
        return False
    parent[key] = text
    return True


def _rewrite(body: str, replacements) -> tuple[str | None, str | None]:
    document = json.loads(body)
    for r in replacements:
        text = r["text"]
        if r["envelope"] is not None:
            envelope = json.loads(r["envelope"])
            envelope["output"] = text
            text = json.dumps(envelope, ensure_ascii=False, separators=(",", ":"))
        if not _set_pointer(document, r["pointer"], text):
            return None, f"missing field {r['pointer']}"
    return json.dumps(document, ensure_ascii=False, separators=(",", ":")), None


def apply_replacements(
    df: DataFrame, body: str = "body", replacements: str = "replacements", output: str = "payload"
) -> DataFrame:
    """Write replaced texts back by JSON pointer; adds ``payload`` and ``rewrite_error``.

    ``replacements`` is an ``array<FIELD>`` with the new texts (put back into their envelope where they had one).  A
    pointer that is gone, or that no longer holds a string, is an error, never a body without the replacement.  Bodies
    without replacements keep their exact bytes and never reach Python.
    """
    @F.pandas_udf("payload string, rewrite_error string")
    def rewrite(bodies: pd.Series, changes: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if b is None else _rewrite(b, c) for b, c in zip(bodies, changes)]
        return pd.DataFrame(rows, columns=["payload", "rewrite_error"])

    touched = F.size(replacements) > 0
    return (
        df.withColumn("_new", rewrite(F.when(touched, F.col(body)), F.when(touched, F.col(replacements))))
        .withColumn(output, F.when(touched, F.col("_new.payload")).otherwise(F.col(body)))
        .withColumn("rewrite_error", F.col("_new.rewrite_error"))
        .drop("_new")
    )


# ---------------------------------------------------------------------------------------------------------------
# Routing
# ---------------------------------------------------------------------------------------------------------------


_ANY_FORMAT = "*"


def assign_provider(
    requests: DataFrame, providers: DataFrame, wanted: str = "provider_name", api_format: str = "api_format"
) -> DataFrame:
    """Add ``provider_id`` and ``reject_reason``: the named provider, or the first enabled one of the same format.

    Provider tables are joined by name and by format; each side is reduced to one row per key first.
    """
    named = providers.groupBy(F.col("name").alias("_name")).agg(
        F.first(F.struct("id", "enabled", "api_format")).alias("_named")
    )
    enabled = providers.where("enabled")
    # One row per format, and one under a name of its own for requests of no known format.
    usual = (
        enabled.select(F.explode(F.array("api_format", F.lit(_ANY_FORMAT))).alias("_format"), "name", "id")
        .groupBy("_format")
        .agg(F.min(F.struct("name", "id")).alias("_usual"))
    )
    asked = F.col(wanted).isNotNull()
    joined = (
        requests.join(named, requests[wanted] == F.col("_name"), "left")
        .withColumn("_wanted_format", F.coalesce(api_format, F.lit(_ANY_FORMAT)))
        .join(usual, F.col("_wanted_format") == F.col("_format"), "left")
    )
    other_format = F.col(api_format).isNotNull() & (F.col("_named.api_format") != F.col(api_format))
    reason = (
        F.when(asked & F.col("_named").isNull(), "unknown_provider")
        .when(asked & ~F.col("_named.enabled"), "disabled_provider")
        .when(asked & other_format, "other_format")
        .when(~asked & F.col("_usual").isNull(), "no_provider")
    )
    chosen = F.when(asked, F.col("_named.id")).otherwise(F.col("_usual.id"))
    return (
        joined.withColumn("reject_reason", reason)
        .withColumn("provider_id", F.when(F.col("reject_reason").isNull(), chosen))
        .drop("_name", "_named", "_format", "_wanted_format", "_usual")
    )

