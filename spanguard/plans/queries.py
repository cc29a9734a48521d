"""The registered queries: each runs one operator of the package over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanguard.functions import checks, content, offsets
from spanguard.functions.frames import exploded
from spanguard.functions.sqlx import let, struct
from spanguard.operators import (
    backtest,
    chain,
    decode,
    extract,
    merge,
    metrics,
    policy,
    pool,
    recognize,
    redact,
    registrations,
    scoring,
)
from spanguard.operators.ruletable import RuleTable
from spanguard.plans import replay, setup
from spanguard.plans.pipeline import combined_hits, fragments, run_pipeline, spans
from spanguard.plans.requests import redact_requests, request_turns
from spanguard.session import scratch
from spanguard.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------------------------------------------------------
# Recognizers
# ---------------------------------------------------------------------------------------------------------------


@query
def email_spans(spark, d):
    return recognize.recognized(setup.documents(spark, d), "text", recognize.email_hits("text"))


@query
def page_spans(spark, d):
    return recognize.detect(tables.read_corpus(spark, d, "pages"))


@query
def bank_card_spans(spark, d):
    return recognize.recognized(setup.documents(spark, d), "text", recognize.run_hits("text", ["bank_card"]))


@query
def ip_spans(spark, d):
    return recognize.recognized(setup.documents(spark, d), "text", recognize.ip_hits("text"))


def _customer_notes(spark, d):
    """Customers as notes with a phone number and a MAC address, some of them malformed or glued to letters."""
    return tables.read_table(spark, d, "customer").select(
        "c_custkey",
        F.expr(
            """concat('Ärzte ', c_name, ' tel 1', c_custkey % 10, lpad(c_custkey * 7919 % 1000000000, 9, '0'),
               if(c_custkey % 4 = 0, 'x', ' '), 'mac ',
               array_join(transform(sequence(0, 5), i -> lower(lpad(hex((c_custkey * (i + 3) * 37) % 256), 2, '0'))),
                          if(c_custkey % 2 = 0, ':', '-')), if(c_custkey % 3 = 0, 'g', '.'))"""
        ).alias("text"),
    )


@query
def mobile_spans(spark, d):
    return recognize.recognized(_customer_notes(spark, d), "text", recognize.run_hits("text", ["private_phone"]))


@query
def mac_spans(spark, d):
    return recognize.recognized(_customer_notes(spark, d), "text", recognize.mac_hits("text"))


@query
def id_card_check(spark, d):
    word = """concat('110105', date_format(o_orderdate, 'yyyyMMdd'), lpad(o_orderkey % 1000, 3, '0'),
              substring('10X98765432x', cast(o_orderkey % 12 as int) + 1, 1))"""
    words = tables.read_table(spark, d, "orders").select("o_orderkey", F.expr(word).alias("word"))
    return words.withColumn("valid", F.expr(recognize.is_id_card("word")))


@query
def credit_code_check(spark, d):
    word = """concat('91', lpad(c_custkey % 1000000, 6, '0'), 'MA', lpad(c_custkey * 31 % 10000000, 7, '0'),
              substring('0123456789ABCDEFGHJKLMNPQRTUWXYZ', cast(c_custkey % 32 as int) + 1, 1))"""
    words = tables.read_table(spark, d, "customer").select("c_custkey", F.expr(word).alias("word"))
    return words.withColumn("valid", F.expr(recognize.is_credit_code("word")))


@query
def id_card_spans(spark, d):
    """Order texts with a number that may be an ID card's, some of them glued to letters."""
    text = """concat('Ärzte 110105', date_format(o_orderdate, 'yyyyMMdd'), lpad(o_orderkey % 1000, 3, '0'),
              substring('10X98765432x', cast(o_orderkey % 12 as int) + 1, 1), if(o_custkey % 5 = 0, 'é', if(o_custkey % 5 = 1, 'a', '.')))"""
    rows = tables.read_table(spark, d, "orders").select("o_orderkey", F.expr(text).alias("text"))
    return recognize.recognized(rows, "text", recognize.run_hits("text", ["id_card"]))


@query
def credit_code_spans(spark, d):
    text = """concat('ñ 91', lpad(c_custkey % 1000000, 6, '0'), 'MA', lpad(c_custkey * 31 % 10000000, 7, '0'),
              substring('0123456789ABCDEFGHJKLMNPQRTUWXYZ', cast(c_custkey % 32 as int) + 1, 1), if(c_custkey % 7 = 0, '0', ' é'))"""
    rows = tables.read_table(spark, d, "customer").select("c_custkey", F.expr(text).alias("text"))
    return recognize.recognized(rows, "text", recognize.run_hits("text", ["credit_code"]))


@query
def luhn_check(spark, d):
    word = "concat(cast(30 + o_orderkey % 70 as string), lpad(o_orderkey * 1000003 % 100000000000000, 14, '0'))"
    words = tables.read_table(spark, d, "orders").select("o_orderkey", F.expr(word).alias("word"))
    return words.select(
        "*", F.expr(checks.luhn_ok("word")).alias("luhn"), F.expr(checks.issuer_ok("word")).alias("issuer")
    )


@query
def ipv4_public(spark, d):
    word = """concat(element_at(array('8', '10', '100', '127', '169', '172', '192', '198', '203', '224', '0', '255', '01'),
              cast(o_orderkey % 13 as int) + 1), '.', element_at(array('0', '18', '51', '64', '88', '168', '254', '256', '16'),
              cast(o_orderkey % 9 as int) + 1), '.', element_at(array('0', '2', '99', '100', '113', '7'),
              cast(o_orderkey % 5 as int) + 1), '.', o_custkey % 300)"""
    words = tables.read_table(spark, d, "orders").select("o_orderkey", F.expr(word).alias("word"))
    return words.withColumn("public", F.expr(checks.ipv4_public("word")))


@query
def ipv6_public(spark, d):
    word = """concat(element_at(array('2606:4700', '2001:db8', '2001:1ff', '2001:200', 'fe80', 'fc00:1', 'ff02', '64:ff9b',
              '64:ff9b:1', '100', '2002:1', '3fff:fff', '3fff:1000', '5f00', ':', '0:0:0:0:0:ffff:808', '::ffff:a00'),
              cast(o_orderkey % 17 as int) + 1), element_at(array('::', ':0:0:', ':1:2:3:4:5:', ':'),
              cast(o_orderkey % 4 as int) + 1), lower(hex(o_custkey)))"""
    words = tables.read_table(spark, d, "orders").select("o_orderkey", F.expr(word).alias("word"))
    return words.withColumn("public", F.expr(checks.ipv6_public("word")))


# ---------------------------------------------------------------------------------------------------------------
# Merge, scorers, registrations
# ---------------------------------------------------------------------------------------------------------------


@query
def arbitrated_spans(spark, d):
    return recognize.detect(setup.documents(spark, d))


@query
def scored_spans(spark, d):
    scored = setup.SCORER.with_hits(setup.documents(spark, d), "text", "hits")
    return exploded(scored, ["doc_id"], "hits", "h").select("doc_id", "h.*")


@query
def lexicon_hits(spark, d):
    scored = setup.LEXICON.with_hits(setup.documents(spark, d), "text", "hits")
    return exploded(scored, ["doc_id"], "hits", "h").select("doc_id", "h.*")


@query
def long_text_hits(spark, d):
    """The lexicon as a loaded model that takes 400 at a time: windows, moved and joined, give what whole texts give."""
    entries = setup.LEXICON.entries

    def load():
        def model(texts):
            return [
                [(g, v, len(t[: m.start()].encode()), len(t[: m.end()].encode())) for n, g, v in entries for m in re.finditer(re.escape(n), t)]
                for t in texts
            ]

        return model

    scorer = scoring.ModelScorer(load, "lexicon-model", 400, lambda t: sum(1 + (c > "\x7f") for c in t))
    scored = scorer.with_hits(setup.documents(spark, d), "text", "hits")
    return exploded(scored, ["doc_id"], "hits", "h").select("doc_id", "h.*")


@query
def overlapping_spans(spark, d):
    """Every scorer hit with every certain hit that it overlaps, whatever their categories."""
    pairs = merge.overlapping(scored_spans(spark, d), arbitrated_spans(spark, d), ["doc_id"])
    named = lambda s: [F.col(f"{s}.{c}").alias(f"{s}_{c}") for c in ("entity_group", "start", "end")]
    return pairs.select("a.doc_id", *named("a"), *named("b"))


@query
def combined_spans(spark, d):
    merged = combined_hits(setup.documents(spark, d), scorer=setup.SCORER)
    return exploded(merged, ["doc_id"], "hits", "h").select("doc_id", "h.*")


@query
def registered_hits(spark, d):
    return registrations.registered_hits(setup.documents(spark, d), setup.POLICY.registrations())


@query
def registered_hits_automaton(spark, d):
    found = registrations.with_registered_hits(
        setup.documents(spark, d), "text", "hits", setup.POLICY.registrations()
    )
    return exploded(found, ["doc_id"], "hits", "h").select("doc_id", "h.*")


@query
def category_dim(spark, d):
    """Every category with its rank and kind, and how many built-in hits the documents have of it."""
    known = recognize.Recognizers()
    found = recognize.detect(setup.documents(spark, d)).groupBy("entity_group").agg(F.count(F.lit(1)).alias("hits"))
    rows = [(name, rank, known.kind_of(name)) for name, rank, _ in setup_categories()]
    dim = spark.createDataFrame(rows, "entity_group string, specificity int, kind string")
    return dim.join(found, "entity_group", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def setup_categories():
    from spanguard.schemas import CATEGORIES

    return CATEGORIES


def _image_texts(spark, d):
    """Customers as texts with a small PNG, JPEG or GIF in base64; one in five has lost its last bytes."""
    payload = "lpad(hex(c_custkey), 16, '0')"
    data = f"""case c_custkey % 3 when 0 then concat('89504E470D0A1A0A0000000D49484452', {payload}, if(c_custkey % 5 = 0, '', '49454E44AE426082'))
        when 1 then concat('FFD8FFE0', {payload}, {payload}, {payload}, if(c_custkey % 5 = 0, '0000', 'FFD9'))
        else concat('474946383961', {payload}, {payload}, if(c_custkey % 5 = 0, '00', '3B')) end"""
    text = F.expr(f"concat('é see ', base64(unhex({data})), ' then ', c_name)")
    return tables.read_table(spark, d, "customer").select("c_custkey", text.alias("text"))


@query
def image_ranges(spark, d):
    return exploded(_image_texts(spark, d), ["c_custkey"], F.expr(content.image_ranges("text")), "r").select("c_custkey", "r.*")


@query
def image_scoring_texts(spark, d):
    """What a scorer sees of those texts."""
    return _image_texts(spark, d).select("c_custkey", F.expr(content.scoring_text("text")).alias("seen"))


@query
def trimmed_hits(spark, d):
    """Hits with blank edges, inside a character, beyond the end or turned round: which are usable, and what is left of them."""
    text = F.concat(F.lit(" \u00a0\t"), F.expr("substring(text, cast(doc_id % 50 as int) + 1, 10)"), F.lit("\u3000 é\n"))
    rows = setup.documents(spark, d).select("doc_id", text.alias("text")).withColumn("raw", F.col("text").cast("binary"))
    size = "octet_length(raw)"
    hits = f"""array(named_struct('start', 0, 'end', {size}), named_struct('start', 2, 'end', {size}), named_struct('start', 0, 'end', {size} + 1),
        named_struct('start', 3, 'end', {size} - 4), named_struct('start', 5, 'end', 4), named_struct('start', 0, 'end', 3))"""
    listed = rows.select("doc_id", "raw", F.posexplode(F.expr(hits)).alias("nth", "h"))
    usable = listed.withColumn("valid", F.expr(offsets.valid_hit("raw", "h")))
    left = F.when(F.col("valid"), F.expr(offsets.trimmed("raw", "h.start", "h.end")))
    return usable.withColumn("t", left).select("doc_id", "nth", "valid", "t.start", "t.end")


@query
def windows(spark, d):
    cut = scoring.windows(setup.documents(spark, d), 500)
    return cut.select("doc_id", "window", "char_start", "byte_start", F.char_length("chunk").alias("chars"))


def dear_lines(text: str) -> int:
    """A cost that is uneven: a line end costs as much as ten characters."""
    return len(text) + 9 * text.count("\n")


@query
def adaptive_windows(spark, d):
    cut = scoring.window_table(400, dear_lines)(F.col("text").outer())
    rows = setup.documents(spark, d).lateralJoin(cut)
    return rows.select("doc_id", "window", "char_start", "byte_start", F.char_length("chunk").alias("chars"))


@query
def window_reconcile(spark, d):
    cut = scoring.windows(setup.documents(spark, d), 300)
    found = exploded(setup.SCORER.with_hits(cut, "chunk", "hits"), ["doc_id", "chunk", "byte_start"], "hits", "h")
    local = found.select("doc_id", "chunk", "byte_start", "h.*")
    return merge.reconcile(scoring.rebase(local), ["doc_id"]).select("doc_id", "entity_group", "start", "end", "score")


# ---------------------------------------------------------------------------------------------------------------
# Policy
# ---------------------------------------------------------------------------------------------------------------


@query
def condition_match(spark, d):
    people = tables.read_table(spark, d, "customer").withColumn("entity_group", F.lit("private_person"))
    span = dict(group="entity_group", score="c_acctbal / 10000", word="c_name")
    names = {
        "is_exact": policy.keyword("CUSTOMER#000000007"),
        "is_exact_case": policy.keyword("CUSTOMER#000000007", case_sensitive=True),
        "has_part": policy.keyword("omer#00000000", "substring", True),
        "has_glob": policy.keyword("c?stomer#*1*2?", "glob"),
        "is_long": policy.character_length("greater", 17),
        "is_sure": policy.confidence("greater", 0.5),
        "nested": policy.all_of(
            policy.any_of(policy.confidence("less", 0.1), policy.keyword("*9", "glob")), policy.entity("private_person")
        ),
        "none_of": policy.any_of(),
        "all_of_none": policy.all_of(),
    }
    return people.select("c_custkey", *[policy.matches(node, **span).alias(n) for n, node in names.items()])


@query
def policy_eval(spark, d):
    return policy.evaluate(combined_spans(spark, d), setup.POLICY)


@query
def policy_fallback(spark, d):
    strict = policy.evaluate(combined_spans(spark, d), policy.builtin_policy().with_fallback("redact"))
    return strict.groupBy("entity_group", "action", "matched_rule_id").agg(F.count(F.lit(1)).alias("n"))


@query
def policy_eval_joined(spark, d):
    """Keyword rules from a table, all other rules compiled; the same answer as ``policy_eval``."""
    compiled = policy.Policy(tuple(r for r in setup.POLICY.rules if r.source != "approval"))
    table = policy.rules_frame(spark, setup.POLICY.rules)
    return policy.evaluate_registered(combined_spans(spark, d), table, compiled)


@query
def policy_violations(spark, d):
    """Customers as rules, some of them broken."""
    condition = F.expr(
        """case c_custkey % 5 when 0 then
             concat('{"kind":"filter","filter":{"kind":"confidence","operator":"greater","value":', c_custkey % 3, '.5}}')
           when 1 then '{"kind":"all","conditions":[{"kind":"filter","filter":{"kind":"keyword","pattern":{"text":"  ","kind":"substring","case_sensitive":false}}}]}'
           else concat('{"kind":"filter","filter":{"kind":"keyword","pattern":{"text":"', c_name, '","kind":"exact","case_sensitive":false}}}') end"""
    )
    rules = tables.read_table(spark, d, "customer").select(
        F.concat(F.lit("rule."), "c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.lit(100).alias("priority"),
        condition.alias("condition_json"),
        F.when(F.col("c_custkey") % 2 == 0, "redact").otherwise("release").alias("action"),
        F.lit(True).alias("enabled"),
        F.when(F.col("c_custkey") % 7 == 0, "approval").otherwise("console").alias("source"),
        F.when(F.col("c_custkey") % 14 == 0, "secret").alias("category"),
    )
    return policy.rule_violations(rules)


# ---------------------------------------------------------------------------------------------------------------
# Redaction
# ---------------------------------------------------------------------------------------------------------------


def _document_hits(spark, d):
    docs = setup.documents(spark, d)
    registered = registrations.with_registered_hits(docs, "text", "_registered", setup.POLICY.registrations())
    merged = combined_hits(registered, scorer=setup.SCORER, output="_merged")
    return merged.withColumn("hits", F.concat("_merged", "_registered")).drop("_merged", "_registered")


@query
def decided_spans(spark, d):
    """Spans as first decided: trimmed, completed, judged on their final text."""
    inputs = struct(raw="cast(text as binary)", hits="hits", images=redact.image_ranges("text"))
    decided = let(inputs, lambda c: redact.decided(f"{c}.raw", f"{c}.hits", f"{c}.images", setup.POLICY))
    rows = _document_hits(spark, d).withColumn("s", F.expr(decided))
    return exploded(rows, ["doc_id"], "s", "s").select("doc_id", "s.*")


@query
def final_spans(spark, d):
    """Spans after confirmed credentials were spread and overruled spans were dropped."""
    done = run_pipeline(setup.documents(spark, d), setup.POLICY, scorer=setup.SCORER)
    return exploded(done, ["doc_id"], "spans", "s").select("doc_id", "s.*")


@query
def merged_ranges(spark, d):
    done = run_pipeline(setup.documents(spark, d), setup.POLICY, scorer=setup.SCORER)
    return exploded(done, ["doc_id"], "redact_ranges", "r").select("doc_id", "r.*")


@query
def redacted_documents(spark, d):
    done = run_pipeline(setup.documents(spark, d), setup.POLICY, scorer=setup.SCORER)
    return tables.payloads(done).select("doc_id", "payload", "changed")


@query
def registered_table_redaction(spark, d):
    """Documents redacted under more than 100,000 decisions on single texts, which stay a table."""
    done = run_pipeline(setup.documents(spark, d), RuleTable(setup.decision_rules(spark, d)), scorer=setup.SCORER)
    return done.select("doc_id", F.col("redacted_text").alias("payload"), "released", "redacted")


@query
def registered_table_rules(spark, d):
    """How many spans each rule of that table has decided; the 50 with the most."""
    found = combined_hits(setup.documents(spark, d), scorer=setup.SCORER)
    rules = RuleTable(setup.decision_rules(spark, d)).narrowed(found, "text")
    hits = rules.with_registered_hits(found.select("doc_id", "text"), "text", "hits")
    spans = exploded(hits, ["doc_id"], "hits", "h").select("doc_id", "h.*")
    # Spans are decided by these three: those that are equal in them are counted before.
    alike = spans.groupBy("entity_group", "score", "word").agg(F.count(F.lit(1)).alias("n"))
    counted = rules.evaluate(alike).groupBy("matched_rule_id", "action", "priority").agg(F.sum("n").alias("spans"))
    return counted.orderBy(F.desc("spans"), "matched_rule_id").limit(50)


@query
def redaction_counts(spark, d):
    done = run_pipeline(setup.documents(spark, d), setup.POLICY, scorer=setup.SCORER)
    return done.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if("changed").alias("changed"),
        F.sum("released").alias("released"),
        F.sum("redacted").alias("redacted"),
    )


# ---------------------------------------------------------------------------------------------------------------
# Audit pool
# ---------------------------------------------------------------------------------------------------------------


@query
def pool_fragments(spark, d):
    rows = fragments(setup.document_pool(spark, d))
    return rows.withColumn("content_hash", F.lower(F.hex("content_hash")))


@query
def pool_spans(spark, d):
    return spans(setup.document_pool(spark, d))


@query
def content_summary(spark, d):
    return pool.content_summary(setup.pool_spans(spark, d))


@query
def category_evidence(spark, d):
    counted = pool.category_evidence(setup.pool_spans(spark, d))
    return counted.select("original_text", F.posexplode("categories").alias("place", "c")).select(
        "original_text", "place", "c.*"
    )


def _rules(spark):
    return policy.rules_frame(spark, setup.POLICY.rules)


def _registered(spark):
    return pool.registered_texts(_rules(spark))


@query
def review_unreviewed(spark, d):
    summary = pool.content_summary(setup.pool_spans(spark, d))
    return pool.review(summary, _registered(spark), "unreviewed").select("original_text", "occurrences")


@query
def review_reviewed(spark, d):
    summary = pool.content_summary(setup.pool_spans(spark, d))
    return pool.review(summary, _registered(spark), "reviewed").select("original_text", "occurrences")


@query
def review_page(spark, d):
    page = pool.content_page(setup.pool_spans(spark, d), _rules(spark), "all", 40, 5)
    listed = F.array_join(F.transform("categories", lambda c: F.concat(c["entity_group"], F.lit("="), c["count"])), ",")
    return page.withColumn("categories", listed)


@query
def review_deep_page(spark, d):
    """A page from the middle of the queue, read by rank."""
    pages = pool.content_pages(setup.pool_spans(spark, d), _rules(spark), "unreviewed")
    return pages.page(100, pages.total // 2).select("place", "original_text", "occurrences", "last_seen")


@query
def review_counts(spark, d):
    summary = pool.content_summary(setup.fragments_and_spans(spark, d)[1])
    known = _registered(spark)
    counted = [
        pool.content_count(summary, known, mode).withColumn("mode", F.lit(mode)) for mode in ("unreviewed", "reviewed", "all")
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query
def unstable_texts(spark, d):
    # Every other span as if an earlier policy had decided the other way.
    other = F.when(F.col("action") == "redact", "release").otherwise("redact")
    spans = setup.pool_spans(spark, d).withColumn("action", F.when(F.col("seq") % 2 == 0, other).otherwise(F.col("action")))
    summary = pool.content_summary(spans)
    return summary.where(pool.is_unstable()).select("original_text", "released", "redacted")


@query
def registered_action(spark, d):
    summary = pool.content_summary(setup.pool_spans(spark, d))
    return pool.with_registered_action(summary.select("original_text"), _rules(spark))


@query
def operator_decisions(spark, d):
    summary = pool.content_summary(setup.pool_spans(spark, d))
    return policy.operator_decision(summary.select("original_text"), _rules(spark))


@query
def occurrences(spark, d):
    found, rows = setup.fragments_and_spans(spark, d)
    return pool.occurrences(rows, found, "THEDNT")


@query
def occurrences_of_span(spark, d):
    found, rows = setup.fragments_and_spans(spark, d)
    anchor = "f22:0"
    return pool.occurrences_of_span(rows, found, anchor)


@query
def written_pool(spark, d):
    """Spans read back from a pool that was written by day, fragments and spans together."""
    path = scratch(spark, "by-day")
    tables.write_pool(setup.document_pool(spark, d), path)
    return tables.read_spans(spark, path)


@query
def loaded_policy(spark, d):
    """Spans judged by a policy that was written as tables and read again."""
    rules, fallback = scratch(spark, "rules"), scratch(spark, "fallback")
    policy.rules_frame(spark, setup.POLICY.rules).write.parquet(rules)
    spark.createDataFrame([("release",)], "action string").write.parquet(fallback)
    return policy.evaluate(combined_spans(spark, d), tables.read_policy(spark, rules, fallback))


@query
def stored_providers(spark, d):
    path = scratch(spark, "providers")
    rows = tables.read_table(spark, d, "nation").select(F.concat(F.lit("id"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    rows.write.parquet(path)
    everyone = tables.read_providers(spark, path)
    one = tables.read_providers(spark, path, everyone.first()["name"])
    return everyone.withColumn("named", F.lit(False)).unionByName(one.withColumn("named", F.lit(True)))


@query
def json_fragments(spark, d):
    """Supplier and part names as JSON arrays of texts, one file for each of their first letters; empty texts are left out."""
    path = scratch(spark, "fragments")
    names = tables.read_table(spark, d, "part").select(F.when(F.col("p_partkey") % 9 > 0, F.col("p_name")).otherwise("").alias("text"))
    listed = names.groupBy(F.substring("text", 1, 1).alias("first")).agg(F.to_json(F.collect_list(F.struct("text"))).alias("value"))
    listed.repartition("first").write.partitionBy("first").text(path)
    return tables.read_fragments_json(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query
def requests_since(spark, d):
    """Requests of the last 48 hours before the newest one, from a written table."""
    path = scratch(spark, "requests")
    setup.event_requests(spark, d).select("request_id", "started_at").write.parquet(path)
    now = tables.read_requests(spark, path).agg(F.max("started_at")).first()[0]
    return tables.read_requests(spark, path, metrics.since(now, 48))


@query
def spans_of_fragment(spark, d):
    return pool.spans_of(setup.pool_spans(spark, d), "f22")


@query
def fragment_detail(spark, d):
    found, rows = setup.fragments_and_spans(spark, d, "redacted_text")
    detail = pool.fragment_of_span(found, rows, "f22:1")
    return detail.select(
        "id", "request_id", "api_format", "path", "redacted_text", "created_at",
        F.array_join(F.transform("spans", lambda s: F.concat(s["id"], F.lit("="), s["action"])), ",").alias("spans"),
    )


@query
def forgotten_rules(spark, d):
    rows = setup.pool_spans(spark, d)
    left = _rules(spark).where(F.col("source") != "builtin")
    return pool.forget_rules(rows, left).select("id", "matched_rule_id")


@query
def forgotten_fragments(spark, d):
    found, rows = setup.fragments_and_spans(spark, d)
    return pool.forget_fragments(rows, found.where(F.col("created_at") % 2000 == 0)).select("id", "fragment_id")


@query
def category_backfill(spark, d):
    rows = setup.pool_spans(spark, d)
    stripped = _rules(spark).withColumn("category", F.when(F.col("source") != "approval", F.col("category")))
    return registrations.backfill_category(stripped, rows).select("id", "source", "category")


def _decisions(spark, d):
    """One decision per text of the pool: redact what was never redacted, release the rest."""
    summary = pool.content_summary(setup.fragments_and_spans(spark, d)[1], evidence=True)
    return summary.select(
        "original_text",
        F.when(F.col("redacted") == 0, "redact").otherwise("release").alias("action"),
        F.expr("categories[0].entity_group").alias("entity_group"),
        F.concat(F.lit("operator."), F.sha2("original_text", 256)).alias("new_id"),
    )


@query
def decisions_applied(spark, d):
    rules, _ = registrations.apply_decisions(_rules(spark), _decisions(spark, d))
    return rules.select("id", "name", "priority", "action", "enabled", "source", "category")


@query
def decision_outcome(spark, d):
    return registrations.apply_decisions(_rules(spark), _decisions(spark, d))[1]


# ---------------------------------------------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------------------------------------------


@query
def request_stats(spark, d):
    return metrics.request_stats(setup.event_requests(spark, d), setup.SINCE_MS)


@query
def request_stats_empty(spark, d):
    return metrics.request_stats(setup.event_requests(spark, d), setup.SINCE_MS * 2)


@query
def span_stats_by_group(spark, d):
    return metrics.by_group(setup.pool_spans(spark, d), setup.FIRST_CREATED + 200_000)


@query
def overview_statistics(spark, d):
    found, rows = setup.fragments_and_spans(spark, d)
    stats = metrics.statistics(setup.event_requests(spark, d), found, rows, setup.FIRST_CREATED + 200_000)
    return stats.select(
        *[c for c in stats.columns if not c.endswith("_ratio")],
        F.round("redacted_ratio", 9).alias("redacted_ratio"),
        F.round("cache_hit_ratio", 9).alias("cache_hit_ratio"),
    )


@query
def model_summary(spark, d):
    summary = metrics.model_summary(setup.event_requests(spark, d), setup.SINCE_MS)
    return summary.select(
        "measured_requests",
        "tokens",
        *[F.round(c, 6).alias(c) for c in summary.columns if c.startswith("average_") or c.endswith("per_second")],
        F.col("latest.tokens").alias("latest_tokens"),
        F.col("latest.forward_ms").alias("latest_forward_ms"),
    )


@query
def sample_rates(spark, d):
    samples = metrics.parsed_performance(setup.event_requests(spark, d))
    return samples.select("request_id", F.round(metrics.tokens_per_second(), 6).alias("tokens_per_second"))


@query
def accumulated_performance(spark, d):
    calls = metrics.parsed_performance(setup.event_requests(spark, d)).select("user_id", "seq", "performance.*")
    return metrics.accumulated(calls, ["user_id"])


def _marks(spark, d):
    """Events as stage marks: even ids begin a stage, odd ids end one."""
    return tables.read_table(spark, d, "events").select(
        "user_id",
        F.col("event_id").alias("seq"),
        setup.event_millis().alias("ts_ms"),
        F.when(F.col("event_id") % 2 == 0, "begin").otherwise("end").alias("mark"),
        F.col("event_type").alias("stage"),
    )


@query
def stage_times(spark, d):
    return metrics.stage_times(_marks(spark, d), ["user_id"])


@query
def inference_progress(spark, d):
    marks = tables.read_table(spark, d, "events").select(
        "user_id",
        F.when(F.col("event_type") == "click", "input").when(F.col("event_type") == "view", "batch").alias("mark"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )
    return metrics.progress(marks, ["user_id"])


@query
def new_outcomes(spark, d):
    """Outcomes of users as request ids: the first per id counts, and ids that are in the table already do not."""
    rows = setup.event_requests(spark, d).select(
        F.concat(F.lit("u"), "user_id").alias("request_id"),
        "started_at",
        "duration_ms",
        F.expr("if(seq % 3 = 1, null, seq)").alias("seq"),
    )
    fresh = tables.new_outcomes(rows, rows.where("seq % 40 = 0").select("request_id"), "seq")
    return fresh


@query
def attached_performance(spark, d):
    requests = setup.event_requests(spark, d)
    samples = requests.where(F.col("seq") % 3 == 0).select(
        "request_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("n"), "seq"
    )
    samples = samples.select("request_id", "n", F.concat(F.lit("s"), "seq", F.lit("."), "n").alias("performance_json"))
    return tables.attach_performance(requests, samples, "n").select("request_id", "model_performance_json")


@query
def assigned_providers(spark, d):
    providers = tables.read_table(spark, d, "nation").select(
        F.concat(F.lit("id"), "n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.expr("n_nationkey % 4 <> 1").alias("enabled"),
        F.element_at(F.array(F.lit("openai_chat"), F.lit("anthropic_messages")), (F.col("n_nationkey") % 2 + 1).cast("int")).alias("api_format"),
    )
    requests = tables.read_table(spark, d, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("request_id"),
        F.element_at(
            F.array(*map(F.lit, ["/v1/chat/completions", "/v1/messages", "/v1/responses", "/v1/models"])),
            (F.col("o_orderkey") % 4 + 1).cast("int"),
        ).alias("path"),
        (F.col("o_custkey") % 30).cast("int").alias("n_nationkey"),
        F.expr("o_orderkey % 5 = 0").alias("unnamed"),
    )
    wanted = requests.join(
        tables.read_table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", "left"
    ).select(
        "request_id",
        extract.format_of().alias("api_format"),
        F.when(F.col("unnamed"), F.lit(None)).otherwise(F.coalesce("n_name", F.lit("nobody"))).alias("provider_name"),
    )
    return extract.assign_provider(wanted, providers)


# ---------------------------------------------------------------------------------------------------------------
# Incremental work
# ---------------------------------------------------------------------------------------------------------------


def _turns(spark, d):
    return tables.read_corpus(spark, d, "conversations")


@query
def scannable_turns(spark, d):
    return extract.scannable_turns(_turns(spark, d)).select("conv_id", "turn", "role")


@query
def turn_chain(spark, d):
    return chain.turn_chain(_turns(spark, d), chain.chain_root("stand-in-1")).select("conv_id", "turn", "hash", "parent_hash")


def _stored_nodes(chained):
    """Nodes of an earlier run that saw the first two turns of every conversation."""
    none = F.expr("cast(array() as array<struct<entity_group:string,score:double,start:int,end:int,word:string>>)")
    return chained.where("turn < 2").select("hash", "parent_hash", none.alias("hits")).dropDuplicates(["hash"])


@query
def replay_split(spark, d):
    root = chain.chain_root("stand-in-1")
    stored = _stored_nodes(chain.turn_chain(_turns(spark, d), root))
    # Every third conversation was edited in its second turn; every fifth is scored by another scorer.
    edited = _turns(spark, d).withColumn(
        "text", F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    )
    same = chain.turn_chain(edited.where("conv_id % 5 <> 0"), root)
    other = chain.turn_chain(edited.where("conv_id % 5 = 0"), chain.chain_root("other"))
    split = chain.lookup_nodes(same.unionByName(other), stored)
    return split.select("conv_id", "turn", "already_audited")


@query
def node_violations(spark, d):
    """Stored results of which some have another parent, none at all, or a word that is no slice of its turn."""
    chained = chain.turn_chain(_turns(spark, d), chain.chain_root("stand-in-1")).select("conv_id", "turn", "text", "hash", "parent_hash")
    hits = """case turn % 4 when 1 then null when 2 then array(named_struct('entity_group', 'secret', 'score', 1D, 'start', 0, 'end', 2, 'word', '??'))
              else array(named_struct('entity_group', 'secret', 'score', 1D, 'start', 0, 'end', 0, 'word', '')) end"""
    nodes = chained.select("hash", F.when(F.col("conv_id") % 5 == 0, "x").otherwise(F.col("parent_hash")).alias("parent_hash"), F.expr(hits).alias("hits"))
    found = chain.node_violations(chain.lookup_nodes(chained, nodes))
    return found.groupBy("violation").agg(F.count_distinct("hash").alias("nodes"))


@query
def new_nodes(spark, d):
    chained = chain.turn_chain(_turns(spark, d), chain.chain_root("stand-in-1"))
    split = chain.lookup_nodes(chained, _stored_nodes(chained))
    scored = chain.replay_or_score(split, setup.LEXICON)
    fresh = chain.new_nodes(scored)
    return fresh.select("hash", "parent_hash", F.size("hits").alias("hits"))


@query
def dedup_hits(spark, d):
    scored = chain.dedup_score(setup.documents(spark, d), setup.LEXICON)
    return scored.select("doc_id", F.size("hits").alias("hits"))


@query
def dedup_usage(spark, d):
    docs = setup.documents(spark, d)
    cached = docs.where("doc_id % 10 < 3").select(chain.content_hash("text").alias("hash"))
    return chain.cache_usage(docs, cached)


@query
def cache_retention(spark, d):
    log = tables.read_table(spark, d, "events").select(
        F.concat("event_type", F.lit(":"), "user_id").alias("key"),
        F.ceil(F.col("value") * 10).cast("bigint").alias("bytes"),
        F.col("event_id").alias("at"),
    )
    return chain.retained(log, 400, 100_000)


# ---------------------------------------------------------------------------------------------------------------
# Token predictions
# ---------------------------------------------------------------------------------------------------------------


@query
def label_dim(spark, d):
    """33 labels with the number of tokens that carry each."""
    counted = decode.labelled(setup.embedding_tokens(spark, d)).groupBy("label_id").agg(F.count(F.lit(1)).alias("tokens"))
    return (
        decode.label_dim(spark)
        .join(counted, F.col("id") == F.col("label_id"), "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .drop("label_id")
    )


@query
def token_labels(spark, d):
    labelled = decode.labelled(setup.embedding_tokens(spark, d))
    return labelled.select("doc_id", "token_idx", "label_id", F.round("probability", 9).alias("probability"))


@query
def bioes_spans(spark, d):
    found = decode.decode_spans(decode.labelled(setup.embedding_tokens(spark, d)))
    return found.select("doc_id", "entity_group", "start", "end", F.round("score", 9).alias("score"))


@query
def viterbi_spans(spark, d):
    found = decode.decode_spans(decode.viterbi_labelled(setup.embedding_tokens(spark, d)))
    return found.select("doc_id", "entity_group", "start", "end", F.round("score", 9).alias("score"))


@query
def decoded_words(spark, d):
    found = decode.decode(setup.fitted_tokens(spark, d), setup.documents(spark, d))
    return found.withColumn("score", F.round("score", 9))


@query
def token_violations(spark, d):
    tokens = setup.embedding_tokens(spark, d)
    broken = tokens.withColumn("start", F.expr("if(token_idx = 7 and doc_id % 2 = 0, 1, start)")).withColumn(
        "logits",
        F.expr("if(token_idx = 3 and doc_id % 3 = 0, transform(logits, x -> cast('NaN' as float)), logits)"),
    )
    # Every fifth document has no text.
    broken = broken.withColumn("doc_id", F.expr("if(doc_id % 5 = 4, -1 - doc_id, doc_id)"))
    return decode.token_violations(broken, setup.documents(spark, d))


@query
def prediction_compare(spark, d):
    a, b = setup.embedding_tokens(spark, d), setup.embedding_tokens(spark, d, shift=1)
    compared = decode.compare_predictions(a, b.where("token_idx <> 5"))
    return compared.select(
        "doc_id", "unmatched_tokens", F.round("max_error", 4).alias("max_error"),
        F.round("mean_error", 6).alias("mean_error"), "label_mismatches",
    )


@query
def span_compare(spark, d):
    a = decode.decode_spans(decode.labelled(setup.embedding_tokens(spark, d)))
    b = decode.decode_spans(decode.labelled(setup.embedding_tokens(spark, d, scale=5.0)))
    compared = decode.compare_spans(a, b.where("start % 2 = 0"))
    return compared.withColumn("max_score_error", F.round("max_score_error", 9))


# ---------------------------------------------------------------------------------------------------------------
# Request bodies
# ---------------------------------------------------------------------------------------------------------------


def _fields(bodies):
    good, _ = extract.parse_requests(bodies)
    rows = extract.field_rows(extract.collected_by_format(good), ["request_id"])
    return rows.select("request_id", "ordinal", "pointer", "text", F.col("envelope").isNotNull().alias("wrapped"))


@query
def collect_chat(spark, d):
    return _fields(setup.chat_bodies(spark, d))


@query
def collect_messages(spark, d):
    return _fields(setup.messages_bodies(spark, d))


@query
def collect_responses(spark, d):
    return _fields(setup.responses_bodies(spark, d))


@query
def rejected_requests(spark, d):
    """Event properties and page texts as bodies: what is no JSON object is set aside."""
    events = tables.read_table(spark, d, "events").select(
        F.concat(F.lit("e"), "event_id").alias("request_id"),
        F.expr(
            "case event_id % 4 when 0 then concat('[', props, ']') when 1 then props when 2 then concat(props, '}')"
            " else concat('{\"k\": 0, ', substring(props, 2)) end"
        ).alias("body"),
    )
    pages = tables.read_table(spark, d, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("request_id"),
        F.expr("if(page_id % 2 = 0, html, concat('{\"a\": 1, \"a\": ', to_json(named_struct('html', html)), '}'))").alias("body"),
    )
    good, bad = extract.parse_requests(events.unionByName(pages))
    accepted = good.select("request_id", F.lit("accepted").alias("reject_reason"))
    return accepted.unionByName(bad.select("request_id", "reject_reason"))


@query
def redacted_requests(spark, d):
    """Documents inside responses requests, redacted and written back into their envelope."""
    done, _ = redact_requests(setup.responses_bodies(spark, d), setup.POLICY, setup.SCORER)
    inner = F.get_json_object(F.get_json_object("payload", "$.input[4].output[1].text"), "$.output")
    return done.select("request_id", "released", "redacted", inner.alias("payload_text"), "rewrite_error")


@query
def request_turn_hashes(spark, d):
    good, _ = extract.parse_requests(setup.messages_bodies(spark, d))
    roots = {f: chain.chain_root("stand-in-1", f) for f in ("openai_responses", "openai_chat", "anthropic_messages")}
    turns = request_turns(extract.collected_by_format(good), roots)
    parts = exploded(turns, ["request_id"], "turns", "t").select("request_id", "t.*")
    return parts.select("request_id", "path", "hash", "parent_hash", F.size("fields").alias("fields"))


def _roots(identity: str) -> dict[str, str]:
    return {f: chain.chain_root(identity, f) for f in ("openai_responses", "openai_chat", "anthropic_messages")}


def _replayed_requests(spark, d):
    """Requests one turn later, with what their first turns have left."""
    before = replay.replayed(setup.messages_bodies(spark, d), None, _roots("lexicon-1"), setup.LEXICON)
    return replay.replayed(setup.followup_bodies(spark, d), before.nodes, _roots("lexicon-1"), setup.LEXICON)


@query
def request_replay(spark, d):
    done = _replayed_requests(spark, d).requests
    hits = F.expr("cast(aggregate(_scored, 0, (n, h) -> n + size(h)) as int)")
    audited = F.array_join(F.transform("audited", lambda a: F.when(a, "1").otherwise("0")), "")
    return done.select("request_id", "cached_fragments", "deduplicated_fragments", "inferred_fragments", hits.alias("hits"), audited.alias("audited"))


@query
def request_usage(spark, d):
    """Usage of those requests as request statistics read it from their outcomes, per hour."""
    outcomes = replay.request_outcomes(_replayed_requests(spark, d).redacted(setup.POLICY))
    counted = [metrics.usage_count("cache_usage_json", f"{name}_fragments").alias(f"{name}_fragments") for name in ("cached", "deduplicated", "inferred")]
    return outcomes.groupBy(F.expr("started_at div 3600000").alias("hour")).agg(F.count(F.lit(1)).alias("requests"), *counted)


# ---------------------------------------------------------------------------------------------------------------
# Back-test
# ---------------------------------------------------------------------------------------------------------------


def _replayed(spark, d):
    found, rows = setup.fragments_and_spans(spark, d, "original_text")
    return backtest.replay(found, rows, policy.builtin_policy().with_fallback("redact"))


@query
def policy_backtest(spark, d):
    return backtest.transitions(_replayed(spark, d))


@query
def backtest_expanded(spark, d):
    return backtest.expanded_redactions(_replayed(spark, d))


@query
def backtest_rules(spark, d):
    return backtest.rule_hits(_replayed(spark, d), "builtin.redact.private")


# ---------------------------------------------------------------------------------------------------------------
# Streams over the tables
# ---------------------------------------------------------------------------------------------------------------


def _drained(spark, frame, name: str, complete: bool = False) -> DataFrame:
    """Run a stream over all that is there now, and read what it wrote; with ``complete`` its result after the last batch."""
    from spanguard.session import scratch

    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    stream = frame.writeStream.option("checkpointLocation", state).outputMode("complete" if complete else "append")
    sink = stream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)) if complete else stream.format("parquet").option("path", out)
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _table_stream(spark, d, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of parts; a pattern, as a stream takes no plain path of a file."""
    schema = tables.read_table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


@query
def stream_redact(spark, d):
    from spanguard.streaming import streams

    texts = _table_stream(spark, d, "documents").select("doc_id", "text")
    done = streams.stream_redact(texts, setup.POLICY, scorer=setup.SCORER)
    return _drained(spark, done.select("doc_id", "redacted_text", "released", "redacted"), "redact")


@query
def stream_stats_drained(spark, d):
    """Request statistics of every hour of the events, from a stream that has seen them all."""
    from spanguard.streaming import streams

    events = setup.event_requests_of(_table_stream(spark, d, "events"))
    done = _drained(spark, streams.stream_stats(events, "ts", "60 days", "1 hour"), "stats", complete=True)
    return done.select(F.unix_millis("start").alias("start_ms"), *[c for c in done.columns if c not in ("start", "end")])


@query
def stream_new_turns(spark, d):
    """Conversations as requests that send their history again with every user turn; each turn reaches the output once."""
    from spanguard.functions.frames import written
    from spanguard.streaming import streams

    turns = _turns(spark, d).select("conv_id", "turn", "role", "text")
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    asked = listed.select("conv_id", "all", F.explode(F.expr("filter(all, t -> t.role = 'user')")).alias("u"))
    sent = asked.select(
        F.concat_ws("/", "conv_id", "u.turn").alias("request_id"),
        "conv_id",
        (F.lit(setup.FIRST_CREATED) + F.col("u.turn") * 1000).alias("created_at"),
        F.expr("transform(filter(all, t -> t.turn <= u.turn), t -> named_struct('role', t.role, 'text', t.text))").alias("turns"),
    )
    files = written(sent.repartition(4, "created_at"), "requests")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 2).parquet(files.inputFiles()[0].rsplit("/", 1)[0])
    done = streams.stream_new_turns(stream, chain.chain_root("lexicon-1"), setup.POLICY, setup.LEXICON)
    return _drained(spark, done.select("conv_id", "turn", "role", F.size("hits").alias("hits")), "turns")


@query
def stream_dedup(spark, d):
    from spanguard.streaming import streams

    outcomes = _table_stream(spark, d, "events").select(
        F.concat(F.lit("u"), "user_id").alias("request_id"),
        F.timestamp_millis(setup.event_millis()).alias("ts"),
    )
    once = streams.stream_outcomes(outcomes, "ts", "60 days")
    return _drained(spark, once.select("request_id"), "dedup")
