"""Requests that carry their history: what is scored, what is replayed, what is refused."""

import json

from pyspark.sql import functions as F

from spanguard.operators import chain, extract
from spanguard.operators.policy import builtin_policy
from spanguard.operators.scoring import LexiconScorer
from spanguard.plans import replay
from spanguard.plans.requests import redact_requests, request_turns
from spanguard.schemas import FORMATS, HIT

SCORER = LexiconScorer((("zebra", "private_person", 0.95), ("key", "secret", 0.5)), identity="z")
ROOTS = {f: chain.chain_root("z", f) for f in FORMATS}


def chat(*texts):
    return json.dumps({"messages": [{"role": "user" if i % 2 == 0 else "assistant", "content": t} for i, t in enumerate(texts)]})


def frame(spark, rows):
    return spark.createDataFrame([(r, "/v1/chat/completions", "openai_chat", at, body) for r, at, body in rows], "request_id string, path string, api_format string, created_at long, body string")


def usage(done):
    return {r.request_id: (r.cached_fragments, r.deduplicated_fragments, r.inferred_fragments, list(r.audited)) for r in done.requests.collect()}


def test_each_new_part_is_scored_by_its_first_request(spark):
    first = frame(spark, [("late", 5, chat("zebra one", "answer", "zebra one")), ("early", 4, chat("zebra one")), ("other", 1, chat("", "x", "key zebra", "y", "key zebra")), ("none", 2, "{}")])
    done = replay.replayed(first, None, ROOTS, SCORER)
    # "late" repeats the part of "early" and adds one with the same text, which is a part of its own.
    assert usage(done) == {"early": (0, 0, 1, [False]), "late": (1, 0, 1, [True, False]), "other": (0, 1, 1, [False, False, False]), "none": (0, 0, 0, [])}
    hits = {r.request_id: [[h.word for h in field] for field in r._scored] for r in done.requests.collect()}
    assert hits == {"early": [["zebra"]], "late": [["zebra"], ["zebra"]], "other": [[], ["zebra", "key"], ["zebra", "key"]], "none": []}
    nodes = done.nodes.collect()
    assert len(nodes) == len({n.hash for n in nodes}) == 3 + 5  # answers of the model are parts without fields

    again = frame(spark, [("again", 9, chat("zebra one", "answer", "zebra one", "more", "zebra three")), ("edited", 9, chat("zebra two", "answer", "zebra one"))])
    second = replay.replayed(again, done.nodes.unionByName(done.nodes), ROOTS, SCORER)
    assert usage(second) == {"again": (2, 0, 1, [True, True, False]), "edited": (0, 0, 2, [False, False])}
    otherwise = replay.replayed(again, done.nodes, {f: chain.chain_root("other", f) for f in FORMATS}, SCORER)
    assert usage(otherwise)["again"] == (0, 1, 2, [False, False, False])
    outcome = {r.request_id: json.loads(r.cache_usage_json) for r in replay.request_outcomes(second.redacted(builtin_policy())).collect()}
    assert outcome["again"] == {"cached_fragments": 2, "deduplicated_fragments": 0, "inferred_fragments": 1}


def test_replayed_hits_redact_like_fresh_ones(spark):
    rows = frame(spark, [("a", 1, chat("zebra at a@example.com", "no", "call zebra")), ("b", 2, chat("zebra at a@example.com", "no", "call zebra", "so", "zebra")), ("bad", 3, "[1]"), (None, None, chat("zebra"))])
    done = replay.replayed(rows, replay.replayed(rows.where("request_id = 'a'"), None, ROOTS, SCORER).nodes, ROOTS, SCORER)
    pick = lambda df: sorted((r.request_id or "", r.payload, r.released, r.redacted) for r in df.collect())
    assert pick(done.redacted(builtin_policy())) == pick(redact_requests(rows, builtin_policy(), SCORER)[0])
    assert [(r.request_id, r.reject_reason) for r in done.rejected.collect()] == [("bad", "not_an_object")]


def test_stored_results_that_do_not_fit_are_refused(spark):
    rows = frame(spark, [("a", 1, chat("zebra")), ("b", 1, chat("a zebra"))])
    nodes = replay.replayed(rows, None, ROOTS, SCORER).nodes
    spoil = {
        "parent": nodes.withColumn("parent_hash", F.lit("x")),
        "fields": nodes.withColumn("entities", F.concat("entities", "entities")),
        "words": nodes.withColumn("entities", F.expr(f"array(array(named_struct('entity_group', 'secret', 'score', 1D, 'start', 0, 'end', 5, 'word', 'zebra')))").cast(f"array<array<{HIT}>>")),
        "null": nodes.withColumn("entities", F.lit(None).cast(f"array<array<{HIT}>>")),
    }
    for name, wrong in spoil.items():
        done = replay.replayed(rows, wrong, ROOTS, SCORER)
        refused = sorted(r.request_id for r in done.rejected.where("reject_reason = 'stored_result'").collect())
        assert refused == (["b"] if name == "words" else ["a", "b"]) and done.requests.count() == 2 - len(refused)
    assert replay.replayed(rows.limit(0), nodes, ROOTS, SCORER).requests.count() == 0


def test_bodies_of_all_sizes_have_the_same_turns(spark):
    bodies = [
        ("openai_responses", {"instructions": "é \"q\" \n", "input": [{"role": "user", "content": [{"text": "a", "n": [1, 2.5, None, True]}]}, "direct", {"type": "reasoning", "b": 1, "a": {}}], "x": 1}),
        ("openai_responses", {"input": "only text"}),
        ("openai_responses", {"instructions": None, "input": {"odd": 1}}),
        ("openai_chat", {"system": "never read", "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}, {}]}),
        ("anthropic_messages", {"system": [{"text": "s"}], "messages": [{"role": "user", "content": [{"type": "tool_result", "content": [{"text": "t"}]}]}]}),
        ("anthropic_messages", {"messages": "no list"}),
    ]
    rows = spark.createDataFrame([(str(i), f, json.dumps(b)) for i, (f, b) in enumerate(bodies)], "request_id string, api_format string, body string")
    good, _ = extract.parse_requests(rows)
    turns = lambda df: {r.request_id: r.turns for r in request_turns(extract.collected_by_format(df), ROOTS).collect()}
    small = turns(good)
    assert turns(good.withColumn("parsed", F.lit(None).cast("variant"))) == small
    assert [len(small[str(i)]) for i in range(6)] == [4, 1, 2, 4, 2, 0]


def test_turns_of_bodies_that_no_variant_holds(spark, tmp_path):
    messages = [{"role": "user", "content": "zebra"}, {"role": "assistant", "content": "a"}]
    rows = frame(spark, [("small", 1, json.dumps({"messages": messages}))])
    large = rows.withColumn("request_id", F.lit("large")).withColumn("body", F.concat(F.lit('{"filler": "'), F.repeat(F.lit("x"), 21_000_000), F.lit('", '), F.expr("substring(body, 2)")))
    large.write.parquet(str(tmp_path / "large"))
    nodes = replay.replayed(rows, None, ROOTS, SCORER).nodes
    done = replay.replayed(spark.read.parquet(str(tmp_path / "large")), nodes, ROOTS, SCORER)
    assert [(r.cached_fragments, r.inferred_fragments, r.audited) for r in done.requests.select("cached_fragments", "inferred_fragments", "audited").collect()] == [(1, 0, [True])]


def test_only_asked_parts_of_a_replay_are_made(spark, monkeypatch):
    """no copy of the rows with bodies and texts is written behind the turns; nodes need none of them."""
    names, real = [], replay.written
    monkeypatch.setattr(replay, "written", lambda df, name, *rest: names.append((name, {"body", "_texts"} & set(df.columns))) or real(df, name, *rest))
    done = replay.replayed(frame(spark, [("r1", 1, chat("a zebra and a zebra")), ("r2", 2, chat("a zebra and a zebra"))]), None, ROOTS, SCORER)
    assert [name for name, wide in names if wide] == ["turns"]
    got = {r.request_id: (r.cached_fragments, r.inferred_fragments, [len(h) for h in r._scored]) for r in done.requests.collect()}
    assert got == {"r1": (0, 1, [2]), "r2": (1, 0, [2])}
    assert done.rejected.count() == 0
