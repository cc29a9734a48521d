"""Rows that were lost, multiplied or taken for good: nulls, repeats, ties, predictions that cannot be read."""

import pytest

from pyspark.sql import functions as F

from spanguard.operators import chain, decode, recognize, registrations, scoring
from spanguard.operators.policy import Rule, all_of, entity, glob_pattern, keyword, rule_violations, rules_frame
from spanguard.sources import tables


def test_two_samples_of_a_request_give_one_outcome(spark):
    outcomes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "request_id string, started_at bigint")
    samples = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", None, 1)], "request_id string, performance_json string, seq int")
    got = {r.request_id: r.model_performance_json for r in tables.attach_performance(outcomes, samples, "seq").collect()}
    assert got == {"a": "new", "b": None, "c": None}
    assert tables.attach_performance(outcomes, samples).count() == 3


def test_an_outcome_without_order_keeps_its_values(spark):
    rows = [("a", None, 5), ("b", None, 6), ("b", 9, 7), ("b", 8, 4), (None, 1, 1), ("c", 2, 2), ("c", 2, 2)]
    df = spark.createDataFrame(rows, "request_id string, started_at bigint, duration_ms bigint")
    got = {r.request_id: (r.started_at, r.duration_ms) for r in tables.new_outcomes(df, None).collect()}
    assert got == {"a": (None, 5), "b": (8, 4), None: (1, 1), "c": (2, 2)}
    known = spark.createDataFrame([("a",), (None,)], "request_id string")
    assert {r.request_id for r in tables.new_outcomes(df, known).collect()} == {"b", "c"}


def test_chains_keep_every_row(spark):
    schema = "conv_id string, turn bigint, role string, text string, n int"
    rows = [("c", 0, "u", "a", 1), ("c", 1, "u", "b", 2), ("c", 1, "u", "c", 3), (None, 0, "u", "a", 4), (None, 1, "u", "b", 5), ("d", None, "u", "x", 6), ("e", 5000, "u", "a", 7), ("e", 9001, "u", "b", 8)]
    got = {r.n: (r.hash, r.parent_hash) for r in chain.turn_chain(spark.createDataFrame(rows, schema), "root").collect()}
    assert len(got) == len(rows)
    assert got[4] == got[1] == got[7] and got[5][1] == got[4][0]
    assert got[7][1] == "root" and got[8] == got[5]  # prefixes do not depend on how turns are numbered
    assert len({got[2], got[3]}) == 2 and {got[2][1], got[3][1]} & {got[1][0]}
    blocks = [sorted(map(tuple, chain.turn_chain(spark.createDataFrame(rows, schema), "root", block=b).select("n", "hash").collect())) for b in (1, 3, 2048)]
    assert blocks[0] == blocks[1] == blocks[2]


def test_repeated_nodes_do_not_multiply_turns(spark):
    turns = spark.createDataFrame([("h", "p")], "hash string, parent_hash string")
    hit = "array<struct<entity_group:string,score:double,start:int,end:int,word:string>>"
    nodes = spark.createDataFrame([("h", "p", []), ("h", "p", [])], f"hash string, parent_hash string, hits {hit}")
    assert chain.lookup_nodes(turns, nodes).count() == 1


def tokens(spark, rows):
    schema = "doc_id bigint, token_idx int, start int, end int, logits array<float>"
    return spark.createDataFrame([(d, i, s, e, [float(x)] * 32 + [1.0] if x is not None else None) for d, i, s, e, x in rows], schema)


@pytest.mark.parametrize("viterbi", [False, True])
@pytest.mark.parametrize(
    "rows",
    [
        [(1, 0, 0, 2, float("nan"))],
        [(1, 0, 0, 2, None)],
        [(1, 0, 2, 0, 0)],
        [(1, 0, 2, 4, 0), (1, 1, 0, 2, 0)],
        [(1, 0, None, 2, 0)],
        [(1, 0, 0, 200, 0)],
        [(2, 0, 0, 2, 0)],
    ],
)
def test_unusable_predictions_fail_the_job(spark, rows, viterbi):
    texts = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    assert decode.token_violations(tokens(spark, rows), texts).count() > 0
    with pytest.raises(Exception, match="not usable|outside the text"):
        decode.decode(tokens(spark, rows), texts, viterbi).collect()


def test_decisions_on_case_variants_are_one(spark):
    rules = rules_frame(spark, [])
    asked = [("Eve", "redact", "g", "op1", 1), ("eve", "release", "g", "op2", 2), ("Bob", "redact", "g", "op3", 1)]
    decisions = spark.createDataFrame(asked, "original_text string, action string, entity_group string, new_id string, seq int")
    new, outcome = registrations.apply_decisions(rules, decisions, "seq")
    assert sorted((r.id, r.action) for r in new.collect()) == [("op2", "release"), ("op3", "redact")]
    assert sorted((r.original_text, r.rule_id) for r in outcome.collect()) == [("Bob", "op3"), ("Eve", "op2"), ("eve", "op2")]
    again = spark.createDataFrame([("EVE", "redact", "g", "op8", 1), ("eVe", "redact", "g", "op9", 2)], decisions.schema)
    newer, _ = registrations.apply_decisions(new, again, "seq")
    assert sorted((r.id, r.action) for r in newer.collect()) == [("op2", "redact"), ("op3", "redact")]


def test_only_a_missing_table_counts_as_none(spark, tmp_path):
    assert tables._existing(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"this is no table")
    with pytest.raises(Exception):
        tables._existing(spark, str(tmp_path / "broken")).count()


@pytest.mark.parametrize(
    ("glob", "word", "matches"),
    [
        ("*a*a*a*a*b", "a" * 300, False), ("*a*a*a*a*b", "a" * 300 + "b", True), ("a*", "abc", True), ("*c", "abc", True), ("a*c", "ac", True),
        ("a*a", "a", False), ("*b?d*", "abbcd", True), ("?", "", False), ("*", "", True), ("**", "x\ny", True), ("ab*ba", "aba", False), ("ab*ba", "abba", True),
        ("*.[x]", "a.[x]", True), ("*.[x]", "a.x", False), ("a*b*c", "a c b c", True), ("a*b*bc", "abc", False), ("?*?", "a", False), ("?*?", "ab", True), ("*é?", "caféx", True),
    ],
)
def test_globs(spark, glob, word, matches):
    import fnmatch

    import re

    plain = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), re.S)
    assert bool(plain.fullmatch(word)) == matches if len(word) < 50 else fnmatch is not None
    df = spark.createDataFrame([(word,)], "word string")
    assert df.select(df["word"].rlike(glob_pattern(glob))).first()[0] == matches


def test_broken_rules_are_violations(spark):
    rows = [("a", "n", 1, "{broken", "redact", True, "console", None), ("b", "n", 1, '{"kind":"nothing"}', "redact", True, "console", None), ("c", "n", 1, '{"kind":"filter","filter":{"kind":"entity","group":"g"}}', "redact", True, "console", None)]
    rules = spark.createDataFrame(rows, rules_frame(spark, []).schema)
    assert sorted(map(tuple, rule_violations(rules).collect())) == [("a", "invalid_condition"), ("b", "invalid_condition")]


def test_a_decision_rewrites_a_nested_registration(spark):
    nested = Rule("op1", 500, all_of(entity("g"), keyword("Eve")), "release", "approval.release", True, "approval", "g")
    decisions = spark.createDataFrame([("eve", "redact", "g", "op2")], "original_text string, action string, entity_group string, new_id string")
    new, _ = registrations.apply_decisions(rules_frame(spark, [nested]), decisions)
    assert [(r.id, r.action) for r in new.collect()] == [("op1", "redact")]


def test_words_with_the_mark_are_slices_of_their_text(spark):
    text = "x \x01a@example.org\x01 and b@example.org"
    hits = recognize.detect(spark.createDataFrame([(1, text)], "id int, text string")).collect()
    raw = text.encode()
    assert hits and all(raw[h.start : h.end].decode() == h.word for h in hits)


def test_window_cuts_hold_every_short_text():
    import random

    rng = random.Random(6)
    cost = lambda t: sum(1 if c.isascii() else 5 for c in t)
    for _ in range(200):
        text = "".join(rng.choice("ab") if rng.random() < 0.7 else "中" for _ in range(rng.randrange(0, 300)))
        cuts = list(scoring.window_cuts(text, 60, cost))
        assert all(cost(chunk) <= 60 and text.encode()[offset:].decode().startswith(chunk) and text[first:].startswith(chunk) for first, chunk, offset in cuts)
        for at in range(len(text) - 3):
            assert any(first <= at and at + 3 <= first + len(chunk) for first, chunk, _ in cuts)
    with pytest.raises(ValueError, match="one character"):
        list(scoring.window_cuts("a中", 4, cost))
    assert sum(len(c) for _, c, _ in scoring.window_cuts("a" * 400_000, 100, len)) < 1_200_000


def test_a_model_gets_long_texts_in_windows(spark):
    import re

    def load():
        def model(texts):
            assert all(len(t) <= 50 for t in texts)
            return [[("secret", 0.9, len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in re.finditer("zebra", t)] for t in texts]

        return model

    texts = ["é zebra " * 40, "zebra", "", "x" * 49 + "zebra" + "y" * 49]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("texts", F.array("text", F.lit("zebra")))
    scorer = scoring.ModelScorer(load, "m", 50)
    want = {i: [(len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in re.finditer("zebra", t)] for i, t in enumerate(texts)}
    assert {r.id: [(h.start, h.end) for h in r.hits] for r in scorer.with_hits(df, "text", "hits").collect()} == want
    assert {r.id: [(h.start, h.end) for h in r.hits[0]] for r in scorer.with_nested_hits(df, "texts", "hits").collect()} == want
