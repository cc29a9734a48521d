import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanguard.operators import backtest, chain, decode, extract, merge, metrics, policy, pool, registrations, scoring
from spanguard.operators.policy import builtin_policy, operator_rule
from spanguard.operators.scoring import LexiconScorer
from spanguard.plans.pipeline import fragments, pool_rows, run_pipeline, spans
from spanguard.plans.requests import audited_fields, redact_requests, request_pool, request_turns
from spanguard.schemas import FORMATS
from spanguard.sources import tables
from spanguard.streaming import streams

SPAN_ROW = (
    "id string, fragment_id string, entity_group string, score double, original_text string, action string,"
    " created_at bigint, seq bigint"
)


def span_rows(spark):
    rows = [
        ("s1", "f1", "secret", 0.9, "flip", "redact", 10, 1),
        ("s2", "f1", "secret", 0.7, "flip", "release", 10, 2),
        ("s3", "f2", "private_url", 0.8, "flip", "redact", 9, 3),
        ("s4", "f2", "secret", 0.5, "often", "release", 5, 4),
        ("s5", "f3", "secret", 0.6, "often", "release", 6, 5),
        ("s6", "f3", "secret", 0.6, "often", "release", 6, 6),
        ("s7", "f3", "secret", 0.6, "often", "release", 6, 7),
        ("s8", "f4", "secret", 0.6, "once", "redact", 99, 8),
    ]
    return spark.createDataFrame(rows, SPAN_ROW)


def test_summary_review_and_page(spark):
    summary = pool.content_summary(span_rows(spark), evidence=True)
    rows = {r.original_text: r for r in summary.collect()}
    flip = rows["flip"]
    assert (flip.occurrences, flip.turns, flip.released, flip.redacted) == (3, 2, 1, 2)
    assert (flip.score_min, flip.score_max, flip.first_seen, flip.last_seen) == (0.7, 0.9, 9, 10)
    # Same millisecond: the one written later is the latest.
    assert (flip.anchor_span_id, flip.latest_action) == ("s2", "release")
    assert [(c.entity_group, c["count"]) for c in flip.categories] == [("secret", 2), ("private_url", 1)]
    order = [r.original_text for r in pool.review_order(summary).collect()]
    assert order == ["flip", "often", "once"]
    empty = spark.createDataFrame([], "t string")
    known = spark.createDataFrame([("often",), ("OTHER",)], "t string")
    for mode, with_known, with_empty in (("unreviewed", 2, 3), ("reviewed", 1, 0), ("all", 3, 3)):
        assert pool.review(summary, known, mode).count() == with_known
        assert pool.review(summary, empty, mode).count() == with_empty
    assert pool.page(pool.review_order(summary), 0, -5).count() == 1
    assert [r.original_text for r in pool.page(pool.review_order(summary), 1, 1).collect()] == ["often"]


def test_decisions(spark):
    rules = policy.rules_frame(
        spark,
        [
            operator_rule("a", "release", "Flip", "secret"),
            operator_rule("b", "redact", "flip", "secret"),
            operator_rule("c", "release", "often", "secret"),
            *builtin_policy().rules[:1],
        ],
    )
    decisions = spark.createDataFrame(
        [("flip", "release", "secret", "n1"), ("often", "release", "secret", "n2"), ("new", "redact", "private_url", "n3")],
        "original_text string, action string, entity_group string, new_id string",
    )
    applied, outcome = registrations.apply_decisions(rules, decisions)
    got = {r.id: (r.action, r.priority, r.category, r.name) for r in applied.collect()}
    assert got == {
        "b": ("release", 500, "secret", "approval.release"),
        "c": ("release", 500, "secret", "approval.release"),
        "n3": ("redact", 1000, "private_url", "approval.redact"),
        "builtin.redact.account_number": ("redact", 100, None, "builtin.redact.account_number"),
    }
    assert {r.original_text: (r.rule_id, r.changed) for r in outcome.collect()} == {
        "flip": ("b", True), "often": ("c", False), "new": ("n3", True),
    }
    # The written table compiles to a policy again.
    assert policy.load_policy(applied).registered_texts() == ["new", "flip", "often"]
    filled = registrations.backfill_category(applied.withColumn("category", F.lit(None).cast("string")), span_rows(spark))
    assert {r.id: r.category for r in filled.collect()}["n3"] == "secret"


def test_forgetting(spark):
    rows = span_rows(spark).withColumn("matched_rule_id", F.when(F.col("seq") < 4, "r1").otherwise("r2"))
    left = pool.forget_rules(rows, spark.createDataFrame([("r2",)], "id string"))
    assert {r.matched_rule_id for r in left.collect()} == {None, "r2"} and left.count() == 8
    assert pool.forget_fragments(rows, spark.createDataFrame([("f1",)], "id string")).count() == 2


def test_latency_known_answers(spark):
    rows = [(f"r{d}", 1000, d, 10, 20, '{"cached_fragments": 2, "inferred_fragments": 1.5}') for d in (100, 200, 300, 400)]
    rows.append(("old", 1, 9, 9, 9, "not json"))
    requests = spark.createDataFrame(
        rows, "request_id string, started_at bigint, duration_ms bigint, inference_ms bigint, upstream_ms bigint, cache_usage_json string"
    )
    r = metrics.request_stats(requests, 1000).first()
    assert (r.requests, r.average_ms, r.p50_ms, r.p95_ms, r.max_ms) == (4, 250, 200, 400, 400)
    assert (r.average_inference_ms, r.average_upstream_ms, r.cached_fragments, r.inferred_fragments) == (10, 20, 8, 0)
    none = metrics.request_stats(requests, 5000).first()
    assert set(none.asDict().values()) == {0}
    assert metrics.since(10**12, None) == 10**12 - 24 * metrics.HOUR_MS
    assert metrics.since(5, -3) == 5 and metrics.since(0, 10**9) == -365 * 24 * metrics.HOUR_MS


def test_model_samples(spark):
    def sample(tokens, forward, first=None):
        return json.dumps(
            {"tokens": tokens, "first_result_ms": first, "tokenization_ms": 1.0, "validation_ms": 0.0, "forward_ms": forward, "decoding_ms": 2.0}
        )

    rows = [(1, 1, sample(100, 100.0, 5.0)), (2, 2, sample(300, 500.0)), (3, 3, sample(0, 0.0)), (4, 4, None)]
    df = spark.createDataFrame(rows, "started_at bigint, seq bigint, model_performance_json string")
    r = metrics.model_summary(df, 0).first()
    assert (r.measured_requests, r.tokens, round(r.tokens_per_second, 2)) == (2, 400, 666.67)
    assert r.average_first_result_ms == 5.0 and r.average_forward_ms == 300.0
    assert r.latest.tokens == 0 and r.latest_tokens_per_second is None
    with pytest.raises(Exception):
        metrics.model_summary(df.withColumn("model_performance_json", F.lit("{oops")), 0).collect()


def test_stage_marks_over_blocks(spark):
    marks = [(0, 0, "begin", "a"), (1, 5, "begin", "b"), (2, 25, "end", "b"), (3, 30, "end", "b"), (4, 31, "begin", "a"), (5, 95, "end", "a")]
    df = spark.createDataFrame([("k", *m) for m in marks], "call string, seq bigint, ts_ms bigint, mark string, stage string")
    for block in (1, 7, 1000):
        got = {r.stage: (r.stage_ms, r.calls) for r in metrics.stage_times(df, ["call"], block).collect()}
        assert got == {"b": (20, 1), "a": (64, 1)}


def test_outcomes_first_write_wins(spark, tmp_path):
    path = str(tmp_path / "requests")
    first = spark.createDataFrame([("r1", 5, "x"), ("r1", 3, "y"), ("r2", 1, "z")], "request_id string, started_at bigint, v string")
    tables.write_outcomes(first, path)
    tables.write_outcomes(spark.createDataFrame([("r1", 1, "late"), ("r3", 9, "w")], first.schema), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("r1", 3, "y"), ("r2", 1, "z"), ("r3", 9, "w")]


def conversation(spark, turns, key="c"):
    rows = [(key, i, role, text) for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")


def hashes(df, **kw):
    return [(r.hash, r.parent_hash) for r in chain.turn_chain(df, "root", **kw).orderBy("turn").collect()]


def test_turn_chain_prefixes(spark):
    turns = [("user", f"t{i}") for i in range(9)]
    base = hashes(conversation(spark, turns))
    assert base[0][1] == "root" and all(b[1] == a[0] for a, b in zip(base, base[1:]))
    assert len({h for h, _ in base}) == 9
    for block in (1, 2, 4, 9):
        blocked = hashes(conversation(spark, turns), block=block)
        assert blocked[0][1] == "root" and all(b[1] == a[0] for a, b in zip(blocked, blocked[1:]))
        assert len({h for h, _ in blocked}) == 9
        # A longer conversation keeps the hashes of its prefix, an edit branches off where it is.
        assert hashes(conversation(spark, turns + [("user", "more")]), block=block)[:9] == blocked
        edited = hashes(conversation(spark, turns[:5] + [("user", "other")] + turns[6:]), block=block)
        assert edited[:5] == blocked[:5] and not {h for h, _ in edited[5:]} & {h for h, _ in blocked}
    assert chain.chain_root("a") != chain.chain_root("b")
    assert hashes(conversation(spark, [("user", "a"), ("user", "b")]))[0] != hashes(conversation(spark, [("usera", ""), ("user", "b")]))[0]


def test_replay_and_violations(spark):
    scorer = LexiconScorer((("zebra", "secret", 0.9),))
    first = chain.turn_chain(conversation(spark, [("user", "a zebra"), ("user", "b")]), "root")
    empty = spark.createDataFrame([], "hash string, parent_hash string, hits array<struct<entity_group:string,score:double,start:int,end:int,word:string>>")
    scored = chain.replay_or_score(chain.lookup_nodes(first, empty), scorer)
    nodes = chain.new_nodes(scored)
    assert nodes.count() == 2
    again = chain.lookup_nodes(chain.turn_chain(conversation(spark, [("user", "a zebra"), ("user", "b"), ("user", "zebra")]), "root"), nodes)
    assert [r.already_audited for r in again.orderBy("turn").collect()] == [True, True, False]
    assert chain.new_nodes(chain.replay_or_score(again, scorer)).count() == 1
    assert chain.node_violations(again).count() == 0
    broken = nodes.withColumn("hits", F.expr("transform(hits, h -> named_struct('entity_group', h.entity_group, 'score', h.score, 'start', 0, 'end', h.end, 'word', h.word))"))
    bad = chain.node_violations(chain.lookup_nodes(first, broken)).collect()
    assert [r.violation for r in bad] == ["offsets"]


def test_dedup_and_usage(spark):
    df = spark.createDataFrame([(1, "x zebra"), (2, "x zebra"), (3, ""), (4, "y"), (5, "y"), (6, "y")], "id int, text string")
    got = {r.id: len(r.hits) for r in chain.dedup_score(df, LexiconScorer((("zebra", "secret", 0.9),))).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}
    cached = df.where("id = 4").select(chain.content_hash("text").alias("h"))
    assert tuple(chain.cache_usage(df, cached).first()) == (3, 1, 1)
    assert tuple(chain.cache_usage(df.limit(0), cached).first()) == (0, 0, 0)


def test_retention(spark):
    log = spark.createDataFrame([("a", 40, 1), ("b", 40, 2), ("c", 999, 3), ("a", 40, 4), ("d", 30, 5)], "key string, bytes bigint, at bigint")
    assert {r.key for r in chain.retained(log, 10, 100).collect()} == {"a", "d"}
    assert {r.key for r in chain.retained(log, 1, 100).collect()} == {"d"}
    assert {r.key for r in chain.retained(log, 10, 2000).collect()} == {"a", "b", "c", "d"}


def legal_best(logits):
    """Best legal path by trying all."""
    import itertools

    def mark(i):
        return "O" if i == 0 else decode.BOUNDARIES[(i - 1) % 4]

    def ok(path):
        if mark(path[0]) not in "OBS" or mark(path[-1]) not in "OES":
            return False
        for a, b in zip(path, path[1:]):
            if mark(a) in "OES":
                if mark(b) not in "OBS":
                    return False
            elif (a - 1) // 4 != (b - 1) // 4 or mark(b) not in "IE":
                return False
        return True

    ids = [0, 1, 2, 3, 4, 5, 7]
    return max((p for p in itertools.product(ids, repeat=len(logits)) if ok(p)), key=lambda p: sum(l[i] for l, i in zip(logits, p)))


def test_viterbi_matches_exhaustive_search():
    rng = np.random.default_rng(3)
    for _ in range(20):
        logits = np.full((4, 33), -50.0)
        logits[:, [0, 1, 2, 3, 4, 5, 7]] = rng.normal(size=(4, 7)).round(2)
        path = decode.best_path(logits)
        best = legal_best(logits)
        assert np.isclose(sum(l[i] for l, i in zip(logits, path)), sum(l[i] for l, i in zip(logits, best)))


def token(label, size=33):
    logits = [0.0] * size
    logits[label] = 9.0
    return logits


def test_decode(spark):
    text = "é Mary Ann x"
    secret, person = 1 + 4 * 7, 1 + 4 * 4
    labels = [(0, 0, 1, person), (1, 1, 3, person + 1), (2, 3, 7, person + 2), (3, 7, 7, 0), (4, 7, 11, person + 3), (5, 11, 12, 0), (6, 12, 13, secret + 1)]
    tokens = spark.createDataFrame(
        [(1, i, s, e, token(l)) for i, s, e, l in labels], "doc_id bigint, token_idx int, start int, end int, logits array<float>"
    )
    texts = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = [(r.entity_group, r.start, r.end, r.word) for r in decode.decode(tokens, texts).orderBy("start").collect()]
    # The first span begins inside the two-byte letter and is widened; a stray I opens a span of its own.
    assert got == [("private_person", 0, 7, "é Mary"), ("private_person", 7, 11, " Ann"), ("secret", 12, 13, "x")]
    viterbi = decode.decode(tokens, texts, viterbi=True).where("entity_group = 'secret'").count()
    assert viterbi <= 1
    assert decode.token_violations(tokens, texts).count() == 0
    bad = tokens.withColumn("end", F.when(F.col("token_idx") == 6, 99).otherwise(F.col("end")))
    assert [r.violation for r in decode.token_violations(bad, texts).collect()] == ["outside"]
    short = tokens.withColumn("logits", F.slice("logits", 1, 32))
    assert decode.token_violations(short, texts).count() == 7


def test_windows_find_a_needle_anywhere(spark):
    needle = "NEEDLE-TOKEN"
    texts = [filler * k + needle + filler * 60 for k in (0, 3, 9, 17, 22, 29, 33, 41, 50, 63, 77) for filler in (" ", "中")]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    scorer = LexiconScorer(((needle, "secret", 0.9),))

    def cost(text):
        return sum(1 if c.isascii() else 2 for c in text)

    for cuts in (scoring.windows(df, 60), scoring.adaptive_windows(df, 60, cost)):
        assert cuts.count() > len(texts)
        found = scorer.with_hits(cuts, "chunk", "hits").select("id", "chunk", "byte_start", F.explode_outer("hits").alias("h"))
        local = found.where("h is not null").select("id", "chunk", "byte_start", "h.*")
        merged = merge.reconcile(scoring.rebase(local), ["id"]).collect()
        assert sorted(r.id for r in merged) == list(range(len(texts)))
        for r in merged:
            assert texts[r.id].encode()[r.start : r.end].decode() == needle
    with pytest.raises(Exception, match="outside its window"):
        scoring.rebase(local.withColumn("end", F.col("end") + 1)).collect()


def test_reconcile_forms_agree(spark):
    rows = [("a", 0, 5, 0.5), ("a", 4, 9, 0.9), ("a", 9, 12, 0.1), ("b", 3, 6, 0.2), ("a", 20, 21, 0.3), ("a", 10, 11, 0.7)]
    df = spark.createDataFrame([(1, *r) for r in rows], "id int, entity_group string, start int, end int, score double")
    expected = [("a", 0, 9, 0.9), ("a", 9, 12, 0.7), ("a", 20, 21, 0.3), ("b", 3, 6, 0.2)]
    got = merge.reconcile(df, ["id"]).select("entity_group", "start", "end", "score").collect()
    assert sorted(tuple(r) for r in got) == expected
    nested = df.groupBy("id").agg(F.collect_list(F.struct("entity_group", "score", "start", "end", F.lit("").alias("word"))).alias("hits"))
    text = nested.withColumn("raw", F.lit("x" * 30).cast("binary"))
    rows = text.select(F.explode(F.expr(scoring.reconciled("raw", "hits"))).alias("h")).select("h.*").collect()
    assert sorted((r.entity_group, r.start, r.end, r.score) for r in rows) == expected
    assert all(len(r.word) == r.end - r.start for r in rows)


BODIES = {
    "openai_responses": {
        "instructions": "mail i@example.org",
        "input": [
            {"role": "assistant", "content": "a@example.org"},
            {"type": "custom_tool_call", "name": "exec", "call_id": "k"},
            {"type": "custom_tool_call_output", "call_id": "k", "output": '{"chunk_id":"c","wall_time_seconds":1,"output":"o@example.org"}'},
            {"type": "custom_tool_call_output", "call_id": "z", "output": '{"chunk_id":"c","wall_time_seconds":1,"output":"plain"}'},
        ],
    },
    "anthropic_messages": {"system": "s", "messages": [{"role": "user", "content": [{"type": "tool_result", "content": [{"text": "m@example.org"}]}]}]},
    "openai_chat": {"system": "not read", "messages": [{"role": "user", "content": "nothing"}, {"role": "user", "content": "c@example.org"}]},
}


def request_frame(spark):
    rows = [(f, f, "/p", json.dumps(b)) for f, b in BODIES.items()]
    rows += [("other", "unknown", "/v1/models", '{"text": "q@example.org"}'), ("bad1", "openai_chat", "/p", "[]"), ("bad2", "openai_chat", "/p", '{"a":1}}'), ("bad3", "openai_chat", "/p", '{"a":1} {"b":2}'), ("bad4", "openai_chat", "/p", '{"a":1}, {"v":1'), ("bad5", "openai_chat", "/p", None)]
    return spark.createDataFrame(rows, "request_id string, api_format string, path string, body string")


def test_requests_end_to_end(spark, tmp_path):
    done, quarantine = redact_requests(request_frame(spark), builtin_policy(), LexiconScorer((("plain", "private_date", 0.9),)))
    assert {r.request_id: r.reject_reason for r in quarantine.collect()} == {
        "bad1": "not_an_object", "bad2": "not_json", "bad3": "not_json", "bad4": "not_json", "bad5": "not_json",
    }
    rows = {r.request_id: r for r in done.collect()}
    responses = json.loads(rows["openai_responses"].payload)
    assert responses["instructions"] == "mail <redacted_private_email>"
    assert responses["input"][0]["content"] == "a@example.org"
    assert json.loads(responses["input"][2]["output"])["output"] == "<redacted_private_email>"
    assert json.loads(rows["anthropic_messages"].payload)["messages"][0]["content"][0]["content"][0]["text"] == "<redacted_private_email>"
    assert rows["other"].payload == '{"text": "q@example.org"}'
    assert (rows["openai_responses"].redacted, rows["openai_responses"].released) == (2, 1)
    tables.write_payloads(done, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    kept = request_pool(done, F.lit(5))
    assert kept.count() == 5 and spans(kept).count() == 5
    assert request_pool(done, F.lit(5), F.expr("transform(fields, f -> true)")).count() == 0


def test_fields_of_large_bodies(spark, tmp_path):
    good, _ = extract.parse_requests(request_frame(spark))
    for r in extract.collected_by_format(good).select("api_format", "body", "fields").collect():
        assert [tuple(f) for f in r.fields] == extract.plain_fields(r.body, r.api_format)
    given = request_frame(spark).where("request_id in ('openai_responses', 'anthropic_messages', 'bad1')")
    filler = F.concat(F.lit('"filler": "'), F.repeat(F.lit("x"), 21_000_000), F.lit('"'))
    body = F.when(F.col("body") == "[]", F.concat(F.lit("[{"), filler, F.lit("}]"))).otherwise(F.concat(F.lit("{"), filler, F.lit(", "), F.expr("substring(body, 2)")))
    given.withColumn("body", body).repartition(3, "request_id").write.parquet(str(tmp_path / "large"))
    done, quarantine = redact_requests(spark.read.parquet(str(tmp_path / "large")), builtin_policy())
    assert [(r.request_id, r.reject_reason) for r in quarantine.select("request_id", "reject_reason").collect()] == [("bad1", "not_an_object")]
    small = {r.request_id: r for r in redact_requests(request_frame(spark), builtin_policy())[0].collect()}
    found = done.select("request_id", "fields", "outcomes", "rewrite_error", F.expr("replace(payload, repeat('x', 21000000), '')").alias("payload")).collect()
    assert len(found) == 2
    for r in found:
        assert (r.fields, r.outcomes, r.rewrite_error) == (small[r.request_id].fields, small[r.request_id].outcomes, None)
        assert json.loads(r.payload) == {"filler": "", **json.loads(small[r.request_id].payload)}


def test_vanished_pointer_is_an_error(spark, tmp_path):
    df = spark.createDataFrame(
        [("r", "f", '{"a":[{"text":5}],"b":"x"}', [(p, "new", None)]) for p in ("/a/0/text", "/a/7/text", "/nope", "", "/a/-", "/b")],
        "request_id string, api_format string, body string, replacements array<struct<pointer:string,text:string,envelope:string>>",
    )
    rows = extract.apply_replacements(df).collect()
    assert [r.payload is None for r in rows] == [True] * 5 + [False]
    assert json.loads(rows[5].payload) == {"a": [{"text": 5}], "b": "new"}
    with pytest.raises(Exception, match="not rewritten"):
        guarded = extract.apply_replacements(df).withColumn("released", F.lit(0)).withColumn("redacted", F.lit(0))
        tables.write_payloads(guarded, str(tmp_path / "out"))


def test_request_turns_replay(spark):
    roots = {f: chain.chain_root("s", f) for f in FORMATS}
    good, _ = extract.parse_requests(request_frame(spark).where("request_id = 'openai_chat'"))
    turns = request_turns(extract.collected_by_format(good), roots)
    row = turns.first()
    # The system part is hashed although its text is never read.
    assert [t.path for t in row.turns] == ["/system", "/messages/0", "/messages/1"]
    assert [list(t.fields) for t in row.turns] == [[], [0], [1]]
    nodes = turns.selectExpr("turns[1].hash as hash")
    assert [tuple(r) for r in audited_fields(turns, nodes).collect()] == [("openai_chat", [0])]
    other = request_turns(extract.collected_by_format(good), {**roots, "openai_chat": chain.chain_root("t", "openai_chat")})
    assert not {t.hash for t in row.turns} & {t.hash for t in other.first().turns}


def test_providers(spark):
    providers = spark.createDataFrame(
        [("1", "zeta", True, "openai_chat"), ("2", "beta", True, "openai_chat"), ("3", "alpha", False, "openai_chat"), ("4", "mid", True, "anthropic_messages")],
        "id string, name string, enabled boolean, api_format string",
    )
    cases = [
        ("openai_chat", None, "2", None), ("openai_chat", "zeta", "1", None), ("openai_chat", "alpha", None, "disabled_provider"),
        ("openai_chat", "mid", None, "other_format"), ("openai_chat", "nobody", None, "unknown_provider"),
        ("openai_responses", None, None, "no_provider"), (None, None, "2", None), (None, "mid", "4", None),
    ]
    df = spark.createDataFrame([(i, f, n) for i, (f, n, _, _) in enumerate(cases)], "i int, api_format string, provider_name string")
    got = extract.assign_provider(df, providers).orderBy("i").collect()
    assert [(r.provider_id, r.reject_reason) for r in got] == [(p, x) for _, _, p, x in cases]


def pool_of(spark, texts, rules):
    rows = [(f"f{i}", "q", "openai_chat", "/p", i, 100 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, request_id string, api_format string, path string, ordinal bigint, created_at bigint, text string")
    return pool_rows(run_pipeline(df, rules, scorer=LexiconScorer((("hunter2-abc", "secret", 0.9), ("Bob", "private_person", 0.9)))))


def test_backtest(spark):
    kept = pool_of(spark, ["pw hunter2-abcd", "pw hunter2-abcd", "Bob", "none"], builtin_policy())
    assert kept.count() == 3
    replayed = backtest.replay(fragments(kept), spans(kept), builtin_policy().with_fallback("redact"))
    # Equal content counts once.
    assert {r.transition: r["count"] for r in backtest.transitions(replayed).collect()} == {"redact->redact": 1, "release->redact": 1}
    assert backtest.expanded_redactions(replayed).first().expanded_redactions == 0
    assert {r.rule_id: r["count"] for r in backtest.rule_hits(replayed, "builtin.").collect()} == {"builtin.redact.secret": 1}


def test_pool_round_trip(spark, tmp_path):
    path = str(tmp_path / "pool")
    tables.write_pool(pool_of(spark, ["pw hunter2-abcd", "Bob and Bob", "none"], builtin_policy()), path)
    assert tables.read_fragments(spark, path).count() == 2
    rows = tables.read_spans(spark, path)
    assert [r.byte_start for r in pool.spans_of(rows, "f1").collect()] == [0, 8]
    assert pool.find_span(rows, "f1:1").first().original_text == "Bob"
    detail = pool.fragment_of_span(tables.read_fragments(spark, path), rows, "f1:0").first()
    assert detail.redacted_text == "Bob and Bob" and len(detail.spans) == 2


def test_json_fragments(spark, tmp_path):
    file = tmp_path / "f.json"
    file.write_text(json.dumps([{"text": "a"}, {"text": ""}, {"text": "b\nc"}]))
    assert sorted(r.text for r in tables.read_fragments_json(spark, str(file)).collect()) == ["a", "b\nc"]


def drain(query):
    query.awaitTermination()


def test_stream_equals_batch_and_policy_is_reread(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "mail a@example.org"), (2, "none")], "id int, text string").write.parquet(source)
    current = {"policy": builtin_policy()}
    stream = spark.readStream.schema("id int, text string").parquet(source)
    writer = streams.redact_batches(lambda: current["policy"], streams.batch_writer(out, streams.run_name(spark, str(tmp_path / "c"))))

    def go():
        drain(stream.writeStream.foreachBatch(writer).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())

    go()
    batch = run_pipeline(spark.read.parquet(source), builtin_policy())
    got = spark.read.parquet(out)
    assert sorted((r.id, r.redacted_text) for r in got.collect()) == sorted((r.id, r.redacted_text) for r in batch.collect())
    current["policy"] = builtin_policy().with_rules(operator_rule("o", "release", "b@example.org", "private_email"))
    spark.createDataFrame([(3, "mail b@example.org")], "id int, text string").write.mode("append").parquet(source)
    go()
    assert {r.id: r.redacted_text for r in spark.read.parquet(out).collect()}[3] == "mail b@example.org"


def test_stream_statistics_drop_late_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "request_id string, ts timestamp, duration_ms bigint, inference_ms bigint, upstream_ms bigint, cache_usage_json string"

    def add(*rows):
        df = spark.createDataFrame([(i, m, d, 1, 1, "{}") for i, m, d in rows], "request_id string, m bigint, duration_ms bigint, inference_ms bigint, upstream_ms bigint, cache_usage_json string")
        df.select("request_id", F.timestamp_millis(F.col("m") * 60000).alias("ts"), "duration_ms", "inference_ms", "upstream_ms", "cache_usage_json").write.mode("append").parquet(source)

    def run(make, name):
        stream = spark.readStream.schema(schema).parquet(source)
        drain(
            make(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c"))
            .outputMode("append").trigger(availableNow=True).start()
        )
        return spark.read.parquet(str(tmp_path / name)).collect()

    stats = lambda s: streams.stream_stats(s, "ts", "10 minutes")
    once = lambda s: streams.stream_outcomes(s, "ts", "30 minutes").select("request_id")
    add(("a", 5, 100), ("b", 20, 300), ("a", 21, 7), ("c", 200, 5))
    run(stats, "stats"), run(once, "once")
    add(("late", 30, 9999), ("d", 400, 5))
    rows = run(stats, "stats")
    assert {(r.requests, r.p50_ms, r.max_ms) for r in rows} >= {(3, 100, 300)}
    assert all(r.max_ms < 9999 for r in rows)
    assert sorted(r.request_id for r in run(once, "once")) == ["a", "b", "c", "d"]


def test_stream_of_conversations_records_new_turns_only(spark, tmp_path):
    nodes, kept = str(tmp_path / "nodes"), str(tmp_path / "kept")
    go = streams.new_turn_batches(nodes, kept, "root", builtin_policy, LexiconScorer((("zebra", "private_date", 0.9),)), "first")

    def batch(number, *requests, go=go, run="first"):
        rows = [(r, "c", i, role, text, 100 * number) for r, turns in requests for i, (role, text) in enumerate(turns)]
        go(spark.createDataFrame(rows, "request_id string, conv_id string, turn bigint, role string, text string, created_at bigint"), number)
        return sorted(x.id for x in spark.read.parquet(f"{kept}/run={run}/batch={number}").collect())

    start = [("user", "a@example.org"), ("assistant", "z@example.org"), ("user", "zebra")]
    assert batch(0, ("r1", start)) == ["r1/0", "r1/2"]
    assert batch(1, ("r2", start + [("user", "b@example.org")]), ("r3", start + [("user", "b@example.org")])) == ["r2/3"]
    # A repeated batch gives the same rows again.
    assert batch(1, ("r2", start + [("user", "b@example.org")]), ("r3", start + [("user", "b@example.org")])) == ["r2/3"]
    edited = [start[0], start[1], ("user", "zebra two"), ("user", "b@example.org")]
    assert batch(2, ("r4", edited)) == ["r4/2", "r4/3"]
    # A run with a new checkpoint starts at 0 again: it replaces nothing and knows the turns of the first run.
    other = streams.new_turn_batches(nodes, kept, "root", builtin_policy, LexiconScorer((("zebra", "private_date", 0.9),)), "second")
    assert batch(0, ("r5", start + [("user", "c@example.org")]), go=other, run="second") == ["r5/3"]
    assert sorted(x.id for x in spark.read.parquet(f"{kept}/run=first/batch=0").collect()) == ["r1/0", "r1/2"]


def test_run_names_belong_to_checkpoints(spark, tmp_path):
    one, two = (streams.run_name(spark, str(tmp_path / c)) for c in ("a", "b"))
    assert one != two and streams.run_name(spark, str(tmp_path / "a")) == one
