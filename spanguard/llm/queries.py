"""Queries of the operators in this folder, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanguard.llm import binary, decontaminate, exact, extract, jaccard, language, negatives, packing, periodic, pii, resampling, sharding, tokens, vectors
from spanguard.llm.rows import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def held_out() -> Column:
    """Rows that no language model learns from; a null id is not among them."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Of the public tokenizers; a parameter of both operators that need one.
TOKENIZER = "word_bpe_49k.json"


@query
def op1_packing(spark, d):
    pieces = packing.packed(table(spark, d, "documents"), tokens.public_path(TOKENIZER), length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_ngram_join(spark, d):
    return jaccard.joined(table(spark, d, "documents"), width=4, least=85)


@query
def op3_quality(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return resampling.resampled(table(spark, d, "documents"), good, fraction=0.5, seed=2024)


@query
def op4_main_text(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", extract.extracted(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query
def op5_near_vectors(spark, d):
    return vectors.near_duplicates(table(spark, d, "embeddings"), least=0.9)


@query
def op6_language(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~held_out()))
    found = docs.select("doc_id", held_out().alias("held_out"), language.predicted(docs, model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query
def op7_personal_data(spark, d):
    found = pii.with_spans(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.KINDS[:4]))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(kind) for kind in pii.KINDS[:4]),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed("pii").alias("spans"),
        *(count(kind) for kind in pii.KINDS[4:]),
        F.aggregate("pii", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("top_score"),
    )


@query
def op8_shards(spark, d):
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, d, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    dealt = sharding.sharded(docs, order, shards=24, seed=2024)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_decontamination(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = decontaminate.matched(docs, table(spark, d, "benchmark"), length=10)
    hit = decontaminate.covered_words()
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("__items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


@query
def op10_token_files(spark, d):
    docs = table(spark, d, "documents")
    return binary.read_back(binary.written(docs, tokens.public_path(TOKENIZER)))


@query
def op11_hard_negatives(spark, d):
    rows = table(spark, d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, label)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The text of one document in ten with its words from one on repeated with a period, both named by its id."""
    planted = r"""transform(array(regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)), w -> transform(array(named_struct('w', w,
        'a', g % size(w), 'p', 1 + (size(w) - g % size(w)) div (3 + g % 8))), s -> array_join(transform(s.w, (x, i) ->
        if(i < s.a, x, s.w[cast(s.a + (i - s.a) % s.p as int)])), ' '))[0])[0]"""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    some = (F.col("h") % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    named = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.expr("h div 10"))
    return named.select("doc_id", F.when(some, F.expr(planted)).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark, d):
    found = periodic.with_runs(with_planted_runs(table(spark, d, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", periodic.strongest("runs"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op13_exact_dedup(spark, d):
    return exact.marked(table(spark, d, "documents"))
