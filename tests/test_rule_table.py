"""Rules on single texts as a table against the same rules compiled; phrase search and ordered tables against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanguard.functions import phrases
from spanguard.functions.ranges import Ordered
from spanguard.operators import merge, ruletable, scoring
from spanguard.operators.policy import Policy, PolicyError, Rule, all_of, builtin_policy, confidence, entity, keyword, operator_rule, rules_frame
from spanguard.operators.registrations import registered_hits
from spanguard.operators.ruletable import RuleTable
from spanguard.operators.scoring import PatternScorer
from spanguard.plans.pipeline import run_pipeline
from spanguard.plans.requests import redact_requests


def plain_places(texts, wanted, exact):
    return sorted(
        (row, i, len(p), n)
        for row, t in enumerate(texts)
        for n, (p, e) in enumerate(zip(wanted, exact))
        for i in range(len(t) - len(p) + 1 if p else 0)
        if t[i : i + len(p)] == p or not e and t[i : i + len(p)].lower() == p.lower()
    )


@pytest.mark.parametrize("piece", [7, 64, 1 << 18])
def test_phrases_are_found_everywhere(monkeypatch, piece):
    monkeypatch.setattr(phrases, "PIECE", piece)
    rng = random.Random(piece)
    for _ in range(60):
        letters = rng.choice(["ab", "aAbB", "aéÉσςΣİß", "abcdefgh \U0001f600 x"])
        say = lambda sizes: "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        texts = [say([0, 1, 3, 20, 90]) for _ in range(rng.randrange(0, 6))]
        wanted = [say([0, 1, 2, 3, 4, 5, 8, 9, 17]) for _ in range(rng.randrange(0, 30))] + [t for t in texts if t][:2]
        exact = np.array([rng.random() < 0.5 for _ in wanted], bool)
        assert phrases.Phrases(wanted, exact).found(texts) == plain_places(texts, wanted, exact)


def test_phrases_with_one_beginning_and_words():
    """Very many phrases that begin alike cost one test per length, not one each."""
    wanted = [f"Customer#{i:09d}" for i in range(50_000)]
    index = phrases.Phrases(wanted, np.zeros(len(wanted), bool))
    assert index.nbytes() < 50_000 * 64 + (1 << 20)
    text = "customer#000000007 " * 2_000
    assert len(index.found([text])) == 2_000
    keys = phrases.Keys(["a", "b", "b", ""], np.array([True, False, True, True]))
    assert keys.find(["a", "b", "c", ""], True).tolist() == [0, 2, -1, 3] and keys.find(["a", "b"], False).tolist() == [-1, 1]
    assert phrases.Phrases([], np.zeros(0, bool)).found(["a"]) == [] and phrases.Keys([], np.zeros(0, bool)).find(["a"], True).tolist() == [-1]


def test_ordered_tables(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), rng.randrange(100), i) for i in range(500)]
    table = Ordered(spark.createDataFrame(rows, "k int, w int, i int").repartition(6), [F.col("k").asc_nulls_first(), F.col("i")], ["w"])
    ranked = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    sums = np.cumsum([r[1] for r in ranked]).tolist()
    got = sorted(table.placed(running={"so_far": "w"}).collect(), key=lambda r: r.place)
    assert [(r.k, r.w, r.i) for r in got] == ranked and [r.place for r in got] == list(range(500)) and [int(r.so_far) for r in got] == sums
    assert table.total == 500 and table.totals == {"w": sums[-1]}
    for first, after in [(0, 10), (490, 520), (123, 321), (600, 700), (5, 5)]:
        part = sorted(table.between(first, after).collect(), key=lambda r: r.place)
        assert [(r.k, r.w, r.i) for r in part] == ranked[first:after]
    nothing = Ordered(spark.createDataFrame([], "k int"), [F.col("k")])
    assert nothing.placed().count() == nothing.between(0, 5).count() == nothing.total == 0


RULES = (
    operator_rule("o.1", "redact", "Project Heron", "secret"),
    operator_rule("o.2", "release", "project heron", "private_person"),
    operator_rule("o.3", "release", "a.b@example.com", "private_email"),
    operator_rule("o.4", "redact", "ana", "private_person"),
    Rule("o.5", 900, keyword("Heron", case_sensitive=True), "release", "", True, "approval", "private_url"),
    Rule("o.6", 900, keyword("gone"), "redact", "", False, "approval", "secret"),
    Rule("o.7", 800, all_of(keyword("inner"), entity("private_person")), "redact", "", True, "approval", "private_person"),
    Rule("o.8", 1000, keyword("é"), "redact", "", True, "approval", "private_date"),
    Rule("c.1", 2000, keyword("banana"), "release"),
    Rule("c.2", 50, all_of(entity("secret"), confidence("greater", 0.1)), "redact"),
    Rule("c.3", -5, keyword("key-77"), "release"),
    Rule("c.4", 100, keyword("key-78"), "release"),
)
POLICY = builtin_policy().with_rules(*RULES)
SCORER = PatternScorer((("secret", 0.9, "key-[0-9]+"), ("private_person", 0.95, "banana|gone|inner| Heron ")), identity="t")
TEXTS = [
    "Project Heron and PROJECT HERON, projects", "banana bananas key-77 key-78 xkey-79y", "write a.b@example.com or c.d@example.com", "inner gone ananana",
    "é É Heron heron", "", None, "nothing at all", "key-77/key-77 and key-77", "Project Heron " * 30,
]


def outcome(rows):
    return sorted(((r.i, [tuple(s) for s in r.spans or []], r.redacted_text, r.released, r.redacted) for r in rows), key=lambda r: r[0])


@pytest.mark.parametrize("shard_bytes", [None, 500])
def test_a_table_decides_like_the_compiled_policy(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(ruletable, "PASSES", 2)
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    table = RuleTable(rules_frame(spark, POLICY.rules), shard_bytes=shard_bytes)
    assert len(table.shards) == (1 if shard_bytes is None else 6)
    want = outcome(run_pipeline(texts, POLICY, scorer=SCORER).collect())
    assert outcome(run_pipeline(texts, table, scorer=SCORER).collect()) == want
    assert sum(len(r[1]) for r in want) > 50
    hits = table.with_registered_hits(texts, "text", "h").where("i <> 6").selectExpr("i", "inline(h)")
    assert sorted(hits.collect()) == sorted(registered_hits(texts, POLICY.registrations()).select(*hits.columns).collect())


def test_a_table_decides_in_requests(spark):
    bodies = [(f"r{i}", '{"messages":[{"role":"user","content":[{"text":"%s"},{"text":"key-77"}]}]}' % t) for i, t in enumerate(TEXTS) if t is not None]
    rows = spark.createDataFrame(bodies, "request_id string, body string").withColumn("api_format", F.lit("openai_chat")).withColumn("path", F.lit("/x"))
    table = RuleTable(rules_frame(spark, POLICY.rules))
    pick = lambda policy: sorted((r.request_id, r.payload, r.released, r.redacted) for r in redact_requests(rows, policy, SCORER)[0].collect())
    assert pick(table) == pick(POLICY)


def test_tables_of_rules_are_checked(spark):
    bad = rules_frame(spark, [Rule("x", 1, keyword("  "), "redact")])
    with pytest.raises(PolicyError, match="empty_pattern"):
        RuleTable(bad)
    none = RuleTable(rules_frame(spark, []), fallback="redact")
    texts = spark.createDataFrame([(1, "mail a@example.com")], "i int, text string")
    want = run_pipeline(texts, Policy((), "redact")).first()
    got = run_pipeline(texts, none).first()
    assert (got.redacted_text, got.spans) == (want.redacted_text, want.spans) and got.redacted == 1


def test_rows_are_decided_by_a_table(spark):
    spans = spark.createDataFrame([("secret", 0.9, "KEY-78"), ("secret", 0.9, "key-77"), ("secret", 0.05, "other"), ("private_person", 0.9, None)], "entity_group string, score double, word string")
    table = RuleTable(rules_frame(spark, POLICY.rules))
    from spanguard.operators.policy import evaluate

    key = lambda r: (r.word or "", r.score)
    got = [(r.word, r.action, r.matched_rule_id, r.priority) for r in sorted(table.evaluate(spans).collect(), key=key)]
    assert got == [(r.word, r.action, r.matched_rule_id, r.priority) for r in sorted(evaluate(spans, POLICY).collect(), key=key)]


def test_windows_as_a_table_function(spark):
    texts = [(1, "a\nb" * 40), (2, ""), (3, None), (4, "é" * 99), (5, "\n" * 5)]
    rows = spark.createDataFrame(texts, "i int, text string")
    cost = lambda t: len(t) + 9 * t.count("\n")
    found = rows.lateralJoin(scoring.window_table(30, cost)(F.col("text").outer())).collect()
    got = [(r.i, r.window, r.char_start, r.chunk, r.byte_start) for r in sorted(found, key=lambda r: (r.i, r.window))]
    assert got == [(i, k, *cut[:2], cut[2]) for i, t in texts if t is not None for k, cut in enumerate(scoring.window_cuts(t, 30, cost))]


def test_overlapping_spans_of_all_lengths(spark):
    rng = random.Random(4)
    span = lambda i: (rng.choice([None, 1, 2]), (lo := rng.choice([0, 63, 64, rng.randrange(5_000), rng.randrange(2_000_000)])), lo + rng.choice([0, 1, 5, 64, 65, 300, 5_000, 3_000_000]), i)
    left, right = [span(i) for i in range(150)], [span(i) for i in range(150)] + [(1, None, 5, 900), (1, 5, None, 901)]
    schema = "k int, start int, end int, i int"
    got = merge.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"]).select("a.i", F.col("b.i").alias("j")).collect()
    want = [(x[3], y[3]) for x in left for y in right if x[0] == y[0] and None not in y[1:3] and x[1] < y[2] and y[1] < x[2]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1_000


def test_texts_are_hashed_once_for_all_shards(monkeypatch):
    """several tables are searched in one pass over the texts, with what each finds on its own."""
    from spanguard.functions import phrases

    words = [["café au", "LAIT", "ab"], ["au lait ", "b", "nothing at all here"], []]
    tables = [phrases.Phrases(w, np.array([i % 2 == 1 for i in range(len(w))], bool)) for w in words]
    texts = ["Café au lait, CAFÉ AU LAIT ab", "", "abab café au LAIT"]
    alone = [t.found(texts) for t in tables]
    made = []
    real = phrases.Windows
    monkeypatch.setattr(phrases, "Windows", lambda points: made.append(len(points)) or real(points))
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    both = [sorted(zip(f[0].tolist(), (f[1] - begins[f[0]]).tolist(), map(len, f[3]), f[2].tolist())) if len(f[0]) else [] for f in phrases.found_in(tables, texts)]
    assert both == alone and alone[0] and alone[1] and len(made) == 1


def test_only_rules_whose_text_can_stand_in_the_texts_are_cut(spark, monkeypatch):
    """a table of many shards is cut as far as the texts need it, and decides as all of it does."""
    monkeypatch.setattr(ruletable, "PASSES", 1)
    away = [operator_rule(f"away.{i}", "redact", f"text {i} that is nowhere", "secret") for i in range(200)]
    odd = [operator_rule("q.1", "redact", 'a "quoted\\ text', "secret"), operator_rule("q.2", "release", "i̇stanbul", "private_address"), operator_rule("q.3", "redact", "ὀδυσσεύς und", "private_person")]
    policy = POLICY.with_rules(*away, *odd, Rule("q.4", 300, keyword("Nothing At All"), "redact", "", False, "approval", "secret"))
    texts = spark.createDataFrame(list(enumerate([*TEXTS, 'say A "QUOTED\\ TEXT twice', "İSTANBUL istanbul", "ὈΔΥΣΣΕΎΣ UND"])), "i int, text string")
    table = RuleTable(rules_frame(spark, policy.rules), shard_bytes=2_500)
    less = table.narrowed(texts, "text")
    assert less.worded.count() < 25 < 200 < table.worded.count() and len(less.shards) * 4 < len(table.shards)
    want = outcome(run_pipeline(texts, policy, scorer=SCORER).collect())
    assert outcome(run_pipeline(texts, table, scorer=SCORER).collect()) == want
    assert sum(s[0] == "secret" for r in want[10:11] for s in r[1]) == 1
    nested = spark.createDataFrame([(["away", None, "text 7 that is NOWHERE"],), (None,)], "t array<string>")
    assert sorted(r.id for r in table.narrowed(nested, "t", nested=True).worded.where("id like 'away%'").collect()) == ["away.7"]


def test_conditions_are_known_by_their_shape(spark):
    """only rules that have no such shape are read as JSON; none is missed, and broken ones are found."""
    shapes = [r for r in rules_frame(spark, POLICY.rules).collect()]
    compact = [r.asDict() | {"condition_json": r.condition_json.replace(": ", ":").replace(", ", ",")} for r in shapes]
    for rows in (shapes, [tuple(r.values()) for r in compact]):
        frame = spark.createDataFrame(rows, ruletable.RULE_SCHEMA)
        got = {(r.id, r.keyword, r.case_sensitive, r.single) for r in RuleTable(frame).worded.collect()}
        assert got == {(i, t, c, i != "o.7") for i, t, c in [("o.1", "Project Heron", False), ("o.2", "project heron", False), ("o.3", "a.b@example.com", False), ("o.4", "ana", False), ("o.5", "Heron", True), ("o.6", "gone", False), ("o.7", "inner", False), ("o.8", "é", False), ("c.1", "banana", False), ("c.3", "key-77", False), ("c.4", "key-78", False)]}
    for bad in (Rule("x", 1, keyword("fine"), "redact", "", True, "approval", None), Rule("x", 1, keyword("fine"), "hide"), Rule(" ", 1, keyword("fine"), "redact")):
        with pytest.raises(PolicyError):
            RuleTable(rules_frame(spark, [bad]))


def test_ranges_are_swept_as_if_compared_one_by_one():
    """coverage, overruling and unions of ranges of many rows against pairs."""
    from spanguard.functions import cover

    rng = random.Random(11)
    for _ in range(200):
        n, reach = rng.randrange(0, 25), rng.choice([6, 30])
        rows = np.array(sorted(rng.randrange(3) for _ in range(n)), np.int64)
        s = np.array([rng.randrange(reach) for _ in range(n)], np.int64)
        e = s + np.array([rng.randrange(1, 8) for _ in range(n)], np.int64)
        [(x, y)] = cover.on_one_line([rows], [(s, e)])
        kind, rank, place = np.array([rng.random() < 0.5 for _ in range(n)], bool), np.array([rng.randrange(4) for _ in range(n)], np.int64), np.array(rng.sample(range(n), n), np.int64)
        some = lambda i, test: any(rows[i] == rows[j] and i != j and test(i, j) for j in range(n))  # noqa: E731, B023
        meets = lambda i, j: s[i] < e[j] and s[j] < e[i]  # noqa: E731, B023
        holds = lambda i, j: s[j] <= s[i] and e[j] >= e[i]  # noqa: E731, B023
        assert cover.held(x, y, place).tolist() == [some(i, lambda i, j: holds(i, j) and place[j] < place[i]) for i in range(n)]
        assert cover.overruled(x, y, rank, kind).tolist() == [some(i, lambda i, j: meets(i, j) and kind[i] != kind[j] and rank[j] > rank[i]) for i in range(n)]
        for test, by in ((cover.covered, holds), (cover.touched, meets)):
            assert test(x[kind], y[kind], x[~kind], y[~kind]).tolist() == [some(i, lambda i, j: not kind[j] and by(i, j)) for i in range(n) if kind[i]]
        order = np.lexsort((e, x))
        want, so_far = [], (-1, 0)
        for k, i in enumerate(order):
            if rows[i] != so_far[0] or s[i] >= so_far[1]:
                want.append(k)
                so_far = (rows[i], e[i])
            so_far = (rows[i], max(so_far[1], e[i]))
        assert cover.unions(x[order], y[order]).tolist() == want


def test_hits_that_all_overlap_are_not_compared_in_pairs(spark):
    """one text whose tens of thousands of hits form one run; pairs of them would take many minutes."""
    import time

    rules = [operator_rule("o.1", "redact", "abab", "private_person"), operator_rule("o.2", "release", "babab", "private_address"), operator_rule("o.3", "redact", "abc", "secret")]
    texts = spark.createDataFrame([(0, "ab" * 15_000 + " abc"), (1, "babab x")], "i int, text string")
    began = time.time()
    rows = {r.i: r for r in run_pipeline(texts, RuleTable(rules_frame(spark, rules))).select("i", "redacted_text", "released", "redacted").collect()}
    assert (rows[0].redacted_text, rows[0].released, rows[0].redacted) == ("<redacted_private_person> <redacted_secret>", 0, 15_000)
    assert (rows[1].redacted_text, rows[1].released, rows[1].redacted) == ("b<redacted_private_person> x", 0, 1)
    assert time.time() - began < 120
