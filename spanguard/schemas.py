"""Row shapes shared by all operators, and the category dimension."""

from __future__ import annotations

from pyspark.sql import types as T

# Category names, arbitration rank and kind of the built-in recognizer (None: only a scorer finds it).
CATEGORIES: tuple[tuple[str, int, str | None], ...] = (
    ("account_number", 7, None),
    ("bank_card", 2, "authoritative"),
    ("credit_code", 1, "authoritative"),
    ("id_card", 0, "authoritative"),
    ("ip_address", 4, "authoritative"),
    ("mac_address", 3, "authoritative"),
    ("private_address", 7, None),
    ("private_date", 7, None),
    ("private_email", 6, "authoritative"),
    ("private_person", 7, None),
    ("private_phone", 5, "additive"),
    ("private_url", 7, None),
    ("secret", 7, None),
)

#: Categories whose redacted text is searched for in the rest of the same fragment.
CREDENTIALS = ("secret", "private_email", "private_url")

KINDS = ("probabilistic", "authoritative", "additive")
ACTIONS = ("release", "redact")
SOURCES = ("builtin", "console", "approval")
FORMATS = ("openai_responses", "openai_chat", "anthropic_messages")

#: Priority of a span that no rule claimed; below every real rule.
FALLBACK_PRIORITY = -(2**31)

#: One detected entity; offsets are UTF-8 bytes.  ``HIT`` is the DDL used inside SQL expressions.
HIT = "struct<entity_group:string,score:double,start:int,end:int,word:string>"
RANGE = "struct<start:int,end:int>"
SPAN = (
    "struct<entity_group:string,score:double,byte_start:int,byte_end:int,original_text:string,"
    "action:string,matched_rule_id:string,priority:int>"
)

RULE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("priority", T.IntegerType(), False),
        T.StructField("condition_json", T.StringType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("enabled", T.BooleanType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("category", T.StringType(), True),
    ]
)

FRAGMENT_COLUMNS = (
    "id", "request_id", "api_format", "path", "content_hash", "original_text", "redacted_text", "created_at",
)
SPAN_COLUMNS = (
    "id", "fragment_id", "entity_group", "score", "char_len", "byte_start", "byte_end", "original_text", "action",
    "matched_rule_id", "created_at", "seq",
)


def specificity(group: str) -> str:
    """SQL: arbitration rank of a category (smaller wins)."""
    ranks = " ".join(f"when '{name}' then {rank}" for name, rank, _ in CATEGORIES)
    return f"(case {group} {ranks} else 7 end)"
