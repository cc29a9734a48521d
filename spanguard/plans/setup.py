"""How the registered queries read the given tables: stand-ins for requests, tokens and rules, and one fixed policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanguard.operators.policy import Rule, all_of, any_of, builtin_policy, decision_priority, entity, keyword, operator_rule, rules_frame
from spanguard.operators.scoring import LexiconScorer, PatternScorer
from spanguard.plans.pipeline import pool_rows, run_pipeline, spans as span_rows
from spanguard.schemas import FORMATS
from spanguard.session import scratch
from spanguard.sources.tables import read_corpus, read_fragments, read_spans, read_table, spread

#: Stand-in for a model: (category, score, pattern).  The secret pattern sees only part of a longer token.
SCORER = PatternScorer(
    (
        ("private_phone", 0.93, r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
        ("secret", 0.97, r"[0-9a-f]{32}"),
        ("private_person", 0.86, r"[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+"),
        ("account_number", 0.91, r"[0-9]{10,12}"),
        ("private_address", 0.72, r"[A-Z_]{6,}"),
        ("private_date", 0.9, r"Version [0-9]\.[0-9]"),
        ("private_url", 0.95, r"example\.com"),
    ),
    identity="stand-in-1",
)

LEXICON = LexiconScorer(
    (
        ("token", "secret", 0.9),
        ("Licensed under", "private_url", 0.7),
        ("the", "private_person", 0.3),
        ("ñ", "private_address", 0.5),
    ),
    identity="lexicon-1",
)

RULES = (
    Rule("console.redact.shout", 150, all_of(entity("private_address"), keyword("*OU*", "glob", True)), "redact"),
    Rule(
        "console.release.mail",
        300,
        all_of(entity("private_email"), any_of(keyword("MAIL2", "substring"), keyword("mail5", "substring"))),
        "release",
    ),
    operator_rule("operator.1", "redact", "GNU General Public License", "secret"),
    operator_rule("operator.2", "release", "mail3.example.com", "private_url"),
    Rule("operator.3", 500, keyword("Apache"), "release", "approval.release", False, "approval", "secret"),
    operator_rule("operator.4", "redact", "THEDNT", "private_address"),
)
POLICY = builtin_policy().with_rules(*RULES)
FIRST_CREATED = 1_700_000_000_000


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return read_corpus(spark, directory, "documents")


def document_fragments(spark: SparkSession, directory: str) -> DataFrame:
    """Documents as judged texts: where they came from and when."""
    table = spread(read_table(spark, directory, "documents"))
    return table.select(
        F.concat(F.lit("f"), "doc_id").alias("id"),
        F.concat(F.lit("req-"), F.col("doc_id") % 97).alias("request_id"),
        F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("doc_id") % 3 + 1).cast("int")).alias("api_format"),
        F.col("source").alias("path"),
        F.col("doc_id").alias("ordinal"),
        (F.lit(FIRST_CREATED) + F.col("doc_id") * 1000).alias("created_at"),
        "doc_id",
        "text",
    )


def document_pool(spark: SparkSession, directory: str) -> DataFrame:
    return pool_rows(run_pipeline(document_fragments(spark, directory), POLICY, scorer=SCORER))


def pool_spans(spark: SparkSession, directory: str) -> DataFrame:
    return span_rows(document_pool(spark, directory))


def fragments_and_spans(spark: SparkSession, directory: str, *texts: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of a written pool, for queries that read it more than once.

    Of the texts of fragments only the named ones are written: a rewritten text that nobody reads is not made.
    """
    path = scratch(spark, "pool")
    unread = [c for c in ("original_text", "redacted_text") if c not in texts]
    document_pool(spark, directory).drop(*unread).write.parquet(path)
    return read_fragments(spark, path), read_spans(spark, path)


def event_millis() -> Column:
    """Event time as unix milliseconds; the table has no time zone, so none may enter here."""
    return F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")


def event_requests(spark: SparkSession, directory: str) -> DataFrame:
    return event_requests_of(read_table(spark, directory, "events"))


def event_requests_of(events: DataFrame) -> DataFrame:
    """Events as request outcomes."""
    duration = F.round(F.col("value") * 100).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("bigint")
    usage = F.concat(F.lit('{"cached_fragments":'), k, F.lit(',"inferred_fragments":'), 100 - k, F.lit("}"))
    sample = F.concat(
        F.lit('{"tokens":'), k * (F.col("event_id") % 5), F.lit(',"first_result_ms":'),
        F.when(F.col("event_id") % 4 == 0, F.lit("null")).otherwise(k.cast("string")),
        F.lit(',"tokenization_ms":'), F.col("event_id") % 7, F.lit(',"validation_ms":'), F.col("event_id") % 3,
        F.lit(',"forward_ms":'), k + 1, F.lit(',"decoding_ms":'), F.col("event_id") % 11, F.lit("}"),
    )
    return events.select(
        F.concat(F.lit("r"), "event_id").alias("request_id"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("p"), F.col("user_id") % 5)).alias("provider_id"),
        F.element_at(F.array(*map(F.lit, FORMATS)), (F.col("event_id") % 3 + 1).cast("int")).alias("api_format"),
        event_millis().alias("started_at"),
        duration.alias("duration_ms"),
        F.expr("event_id % 17").alias("queue_ms"),
        F.floor(duration / 3).cast("bigint").alias("inference_ms"),
        F.floor(duration / 2).cast("bigint").alias("upstream_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(usage).alias("cache_usage_json"),
        F.when(F.col("event_type") == "error", F.lit("upstream")).alias("error_kind"),
        F.when(F.col("event_type") == "click", sample).alias("model_performance_json"),
        F.col("event_id").alias("seq"),
        F.timestamp_millis(event_millis()).alias("ts"),
        "user_id",
        "event_type",
    )


def decision_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Rules of which very many are decisions on single texts: one for each text cut out of documents (12 to 14 characters), 50 for each
    customer and 15 for each part; the console and built-in rules of ``POLICY`` beside them.
    """
    docs = read_table(spark, directory, "documents").where("length(text) >= 60 and doc_id is not null")
    cut = F.expr("substring(text, cast(doc_id % 40 as int) + 1, cast(12 + doc_id % 3 as int))")
    # Texts that differ in case only are one decision, the one of the first document.
    asked = docs.select("doc_id", cut.alias("word")).where(r"word rlike r'[^\s]'").groupBy(F.lower("word").alias("_low"))
    own = asked.agg(F.min(F.struct("doc_id", "word")).alias("_first")).select("_first.*")
    kinds = F.array(*map(F.lit, ("secret", "private_person", "private_address", "private_date")))
    own = own.select(F.concat(F.lit("decision."), "doc_id").alias("id"), "word", (F.col("doc_id") % 3 == 0).alias("releases"), F.get(kinds, (F.col("doc_id") % 4).cast("int")).alias("category"))
    each = lambda table, key, n, word: spread(read_table(spark, directory, table).select(key, *word)).select(key, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("n"), *word).select(
        F.concat_ws(".", F.lit(table), key, "n").alias("id"), F.concat_ws(" ", *word, "n").alias("word"), (F.col("n") % 2 == 0).alias("releases"), F.lit("account_number").alias("category")
    )
    texts = own.unionByName(each("customer", "c_custkey", 50, ["c_name"])).unionByName(each("part", "p_partkey", 15, ["p_name", "p_brand"]))
    pattern = F.struct(F.col("word").alias("text"), F.lit("exact").alias("kind"), F.lit(False).alias("case_sensitive"))
    condition = F.struct(F.lit("filter").alias("kind"), F.struct(F.lit("keyword").alias("kind"), pattern.alias("pattern")).alias("filter"))
    action = F.when(F.col("releases"), "release").otherwise("redact")
    # A word without escapes is put between the two halves of its condition.
    before, behind = F.lit('{"kind":"filter","filter":{"kind":"keyword","pattern":{"text":"'), F.lit('","kind":"exact","case_sensitive":false}}}')
    condition = F.when(~F.col("word").rlike(r'["\\\x00-\x1f]'), F.concat(before, "word", behind)).otherwise(F.to_json(condition))
    decided = texts.select(
        "id",
        F.concat(F.lit("approval."), action).alias("name"),
        F.when(F.col("releases"), decision_priority("release")).otherwise(decision_priority("redact")).alias("priority"),
        condition.alias("condition_json"),
        action.alias("action"),
        F.lit(True).alias("enabled"),
        F.lit("approval").alias("source"),
        "category",
    )
    return decided.unionByName(rules_frame(spark, [r for r in POLICY.rules if r.source != "approval"]))


#: Start of the trailing window used on events: the last 20 of 30 days.
SINCE_MS = 1_704_931_200_000


def embedding_tokens(spark: SparkSession, directory: str, shift: int = 0, scale: float = 10.0) -> DataFrame:
    """Embeddings as token predictions: 20 tokens per document, 33 of the 64 numbers from ``shift`` on."""
    return read_table(spark, directory, "embeddings").select(
        F.floor(F.col("vec_id") / 20).cast("bigint").alias("doc_id"),
        (F.col("vec_id") % 20).cast("int").alias("token_idx"),
        (F.col("vec_id") % 20 * 3).cast("int").alias("start"),
        F.expr("cast(vec_id % 20 * 3 + if(vec_id % 7 = 6, 0, 3) as int)").alias("end"),
        F.expr(f"transform(slice(embedding, {shift + 1}, 33), x -> cast(x * {scale}D as float))").alias("logits"),
    )


def fitted_tokens(spark: SparkSession, directory: str) -> DataFrame:
    """The same tokens with offsets that end where the text of their document does."""
    sizes = read_table(spark, directory, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("_size"))
    tokens = embedding_tokens(spark, directory).join(sizes, "doc_id")
    return tokens.withColumn("start", F.least("start", "_size")).withColumn("end", F.least("end", "_size")).drop("_size")


def _json(column: str) -> str:
    """SQL: a text as JSON string."""
    return f"substring(to_json(array({column})), 2, char_length(to_json(array({column}))) - 2)"


def _bodies(spark: SparkSession, directory: str, prefix: str, path: str, api_format: str, body: str) -> DataFrame:
    return spread(read_table(spark, directory, "documents")).select(
        F.concat(F.lit(prefix), "doc_id").alias("request_id"),
        F.lit(path).alias("path"),
        F.lit(api_format).alias("api_format"),
        (F.lit(FIRST_CREATED) + F.col("doc_id") * 1000).alias("created_at"),
        F.expr(body).alias("body"),
    )


def chat_bodies(spark: SparkSession, directory: str) -> DataFrame:
    """One chat request per document: a system text, the document in a block, and again as the model's answer."""
    body = f"""concat('{{"messages":[{{"role":"system","content":', {_json('lang')},
        '}},{{"role":"user","content":[{{"type":"text","text":', {_json('text')},
        '}},{{"type":"image","url":"u"}}]}},{{"role":"assistant","content":', {_json('text')},
        '}},{{"content":"no role"}}]}}')"""
    return _bodies(spark, directory, "c", "/v1/chat/completions", "openai_chat", body)


def messages_bodies(spark: SparkSession, directory: str) -> DataFrame:
    """One messages request per document: system block, and the document inside a nested tool result."""
    body = f"""concat('{{"system":[{{"text":', {_json('source')},
        '}}],"messages":[{{"role":"user","content":[{{"type":"text","text":"see below"}},{{"type":"tool_result","content":',
        {_json('text')}, '}},{{"type":"tool_result","content":[{{"type":"text","text":', {_json('lang')},
        '}}]}}]}},{{"role":"assistant","content":', {_json('text')}, '}}]}}')"""
    return _bodies(spark, directory, "m", "/v1/messages", "anthropic_messages", body)


def followup_bodies(spark: SparkSession, directory: str) -> DataFrame:
    """The requests of ``messages_bodies`` one turn later: history sent again, in one of five edited, and a new turn."""
    told = "if(doc_id % 5 = 0, concat(text, '!'), text)"
    body = f"""concat('{{"system":[{{"text":', {_json('source')},
        '}}],"messages":[{{"role":"user","content":[{{"type":"text","text":"see below"}},{{"type":"tool_result","content":',
        {_json(told)}, '}},{{"type":"tool_result","content":[{{"type":"text","text":', {_json('lang')},
        '}}]}}]}},{{"role":"assistant","content":"done"}},{{"role":"user","content":[{{"type":"text","text":', {_json('source')},
        '}},{{"type":"text","text":', {_json('source')}, '}},{{"type":"text","text":""}},{{"type":"text","text":', {_json('lang')}, '}}]}}]}}')"""
    return _bodies(spark, directory, "n", "/v1/messages", "anthropic_messages", body)


def responses_bodies(spark: SparkSession, directory: str) -> DataFrame:
    """One responses request per document: instructions, items, and the document in the envelope of a script tool."""
    envelope = f"concat('{{\"chunk_id\":\"k\",\"wall_time_seconds\":0.25,\"output\":', {_json('text')}, '}}')"
    body = f"""concat('{{"instructions":', {_json('source')}, ',"input":["first",{{"role":"assistant","text":"direct","content":"mine"}},',
        '{{"type":"function_call","content":"mine"}},{{"type":"custom_tool_call","name":"exec","call_id":"x"}},',
        '{{"type":"custom_tool_call_output","call_id":"x","output":[{{"text":"Script completed\\\\nWall time 2 seconds\\\\nOutput:\\\\n"}},{{"text":',
        {_json(envelope)}, '}}]}},{{"type":"function_call_output","call_id":"y","output":', {_json('lang')}, '}}]}}')"""
    return _bodies(spark, directory, "o", "/v1/responses", "openai_responses", body)
