import base64

import pytest
from pyspark.sql import functions as F

from spanguard.functions.content import image_ranges, scoring_text
from spanguard.operators.policy import Policy, PolicyError, Rule, all_of, any_of, builtin_policy, confidence, entity, keyword, operator_rule
from spanguard.operators.redact import redact
from spanguard.operators.registrations import registered_hits, with_registered_hits
from spanguard.operators.policy import Registration
from spanguard.operators.scoring import LexiconScorer, ModelScorer
from spanguard.plans.pipeline import run_pipeline
from spanguard.schemas import HIT

PNG = base64.b64encode(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + bytes(30) + b"IEND\xaeB`\x82").decode()


def hit(text, word, group, score=0.95, nth=0):
    raw, at = text.encode(), -1
    for _ in range(nth + 1):
        at = raw.index(word.encode(), at + 1)
    return (group, score, at, at + len(word.encode()), word)


def run(spark, text, hits, policy):
    df = spark.createDataFrame([(text, hits)], f"text string, hits array<{HIT}>")
    row = redact(df, policy).collect()[0]
    for s in row.spans:
        assert text.encode()[s.byte_start : s.byte_end].decode() == s.original_text
    return row


def texts_of(row):
    return [(s.original_text, s.action, s.matched_rule_id) for s in row.spans]


BUILTIN = builtin_policy()


def test_leading_blank_is_kept(spark):
    text = "by  Mary Shelley, 1818"
    row = run(spark, text, [hit(text, "  Mary Shelley", "private_person")], BUILTIN)
    assert row.redacted_text == "by  <redacted_private_person>, 1818"
    assert row.changed and row.redacted == 1 and row.released == 0


def test_unicode_blanks_are_trimmed_and_blank_spans_stay(spark):
    text = "x 　 Mary Shelley y"
    row = run(spark, text, [hit(text, "　 Mary Shelley ", "private_person"), hit(text, "　", "secret")], BUILTIN)
    assert row.redacted_text == "x 　 <redacted_private_person> y"


def test_repeated_values_fall_on_their_own_place(spark):
    text = "Mary Ann met Mary Ann"
    hits = [hit(text, "Mary Ann", "private_person", nth=1)]
    assert run(spark, text, hits, BUILTIN).redacted_text == "Mary Ann met <redacted_private_person>"


def test_overlaps_merge_and_the_first_category_names_them(spark):
    text = "key abcdefgh12345678 end"
    hits = [hit(text, "abcdefgh1234", "secret"), hit(text, "gh12345678", "account_number")]
    row = run(spark, text, hits, BUILTIN)
    assert row.redacted_text == "key <redacted_secret> end" and row.redacted == 2
    assert [tuple(r) for r in row.redact_ranges] == [(4, 20, "secret")]


def test_touching_spans_stay_apart(spark):
    text = "Mary Ann;;Mary Bee"
    hits = [hit(text, "Mary Ann;", "private_person"), hit(text, ";Mary Bee", "private_person")]
    row = run(spark, text, hits, BUILTIN)
    assert row.redacted_text == "<redacted_private_person><redacted_private_person>"


@pytest.mark.parametrize("bad", [(5, 99), (9, 3), (1, 4), (-1, 2)])
def test_invalid_hits_are_dropped(spark, bad):
    text = "é秘密 secret-value"
    row = run(spark, text, [("secret", 0.99, *bad, "?")], BUILTIN)
    assert row.spans == [] and row.redacted_text == text and not row.changed


def test_cut_credentials_are_completed_further_than_other_tokens(spark):
    text = "url https://x.y/z?token=abcdef end"
    assert run(spark, text, [hit(text, "token", "secret")], Policy((), "redact")).redacted_text == "url <redacted_secret> end"
    assert (
        run(spark, text, [hit(text, "oke", "private_person")], Policy((), "redact")).redacted_text
        == "url https://x.y/z?<redacted_private_person>=abcdef end"
    )


def test_long_tokens_are_completed_whole(spark):
    token = "k" * 70000
    text = f"é {token} é"
    row = run(spark, text, [("secret", 0.99, 3 + 35000, 3 + 35010, "k" * 10)], BUILTIN)
    assert row.redacted_text == "é <redacted_secret> é"


def test_images_stay_whole(spark):
    text = f"data:image/png;base64,{PNG} pass-word-1 and pass-word-1"
    inside = ("secret", 0.99, text.index(PNG) + 40, text.index(" pass") + 12, "?")
    row = run(spark, text, [inside], BUILTIN)
    assert PNG in row.redacted_text and "pass-word" not in row.redacted_text
    df = spark.createDataFrame([(text,), ("/9j/" + "A" * 40,), (PNG[:-4],), ("q" + PNG,)], "text string")
    rows = df.select(F.expr(image_ranges("text")).alias("i"), F.expr(scoring_text("text")).alias("s")).collect()
    assert [len(r.i) for r in rows] == [1, 0, 0, 0]
    assert rows[0].s == text.replace(PNG, " " * len(PNG)) and rows[3].s == "q" + PNG


def test_confirmed_credentials_spread_once(spark):
    text = "pw=hunter2xyz; again hunter2xyz, and zhunter2xyz9 hunter2xyz"
    row = run(spark, text, [hit(text, "hunter2xyz", "secret", nth=1)], BUILTIN)
    assert "hunter" not in row.redacted_text
    assert sorted(s.original_text for s in row.spans) == ["hunter2xyz", "hunter2xyz", "pw=hunter2xyz", "zhunter2xyz9"]


def test_other_categories_do_not_spread(spark):
    text = "Mary Shelley and Mary Shelley"
    assert run(spark, text, [hit(text, "Mary Shelley", "private_person")], BUILTIN).redacted_text.endswith("and Mary Shelley")


def test_rules_see_the_final_text(spark):
    # Seven characters are too short for a secret, but the completed token has nine.
    text = "t abcdefghi t"
    assert run(spark, text, [hit(text, "abcdefg", "secret")], BUILTIN).redacted_text == "t <redacted_secret> t"


def test_thresholds_are_strict(spark):
    text = "Anna Bob1 secretabc"
    for word, group, score, action in [
        ("Anna", "private_person", 0.99, "release"),
        ("Bob1 s", "private_person", 0.8, "release"),
        ("secretabc", "secret", 0.81, "redact"),
        ("secretabc", "private_date", 1.0, "release"),
        ("Bob1", "private_email", 0.1, "redact"),
    ]:
        assert run(spark, text, [hit(text, word, group, score)], BUILTIN).spans[0].action == action, (word, group, score)


def test_higher_priority_overrules_the_other_action_only(spark):
    text = "contact mary@example.org today"
    email, domain = hit(text, "mary@example.org", "private_email", 1.0), hit(text, "example.org", "private_url", 1.0)
    policy = BUILTIN.with_rules(operator_rule("o1", "release", "example.org", "private_url"))
    row = run(spark, text, [email, domain], policy)
    assert texts_of(row) == [("example.org", "release", "o1")] and row.redacted_text == text
    # A fallback release never overrules.
    low = Policy((Rule("r", 1, entity("private_email"), "redact"),))
    assert run(spark, text, [email, domain], low).redacted_text == "contact <redacted_private_email> today"
    # Equal priority overrules nothing.
    same = Policy((Rule("a", 5, entity("private_email"), "redact"), Rule("b", 5, entity("private_url"), "release")))
    url = ("private_url", 1.0, *domain[2:])
    assert len(run(spark, text, [email, url], same).spans) == 2


def test_registered_text_is_not_completed(spark):
    text = "pay-value-1"
    person = BUILTIN.with_rules(operator_rule("o1", "redact", "VALUE-1", "private_person"))
    df = spark.createDataFrame([(text,)], "text string")
    assert run_pipeline(df, person).collect()[0].redacted_text == "pay-<redacted_private_person>"
    # A disabled registration is no hit any more, but its text is still left as it is.
    off = BUILTIN.with_rules(
        Rule("o1", 1000, keyword("value-1"), "redact", enabled=False, source="approval", category="private_person")
    ).with_fallback("redact")
    assert run_pipeline(df, off).collect()[0].spans == []
    row = run(spark, text, [hit(text, "value-1", "private_person", 0.1)], off)
    assert row.redacted_text == "pay-<redacted_private_person>"


def test_registered_credentials_still_spread_to_the_whole_token(spark):
    policy = BUILTIN.with_rules(operator_rule("o1", "redact", "value-1", "secret"))
    row = run_pipeline(spark.createDataFrame([("key=value-1",)], "text string"), policy).collect()[0]
    assert [s.original_text for s in row.spans] == ["key=value-1", "value-1"]
    assert row.redacted_text == "<redacted_secret>"


REGISTRATIONS = [
    Registration("aa", "secret", True),
    Registration("Straße", "private_address", False),
    Registration("ΑΣ", "secret", False),
    Registration("İ", "secret", False),
    Registration("a.b\\E*", "secret", True),
    Registration("key", "secret", False),
]


def windows(text, r):
    n = len(r.text)
    for i in range(len(text) - n + 1):
        w = text[i : i + n]
        if w == r.text or (not r.case_sensitive and w.lower() == r.text.lower()):
            start = len(text[:i].encode())
            yield (r.group, 1.0, start, start + len(w.encode()), w)


def test_registered_windows(spark):
    texts = ["aaaa", "STRAßE straße Straßen strasse", "ας ΑΣ ασα ΑΣΑ", "İi̇ İ", "xa.b\\E*x a.bxE", "KEYkey Key", "", "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    expected = sorted((i, *w) for i, t in enumerate(texts) for r in REGISTRATIONS for w in windows(t, r))
    assert sorted(tuple(r) for r in registered_hits(df, REGISTRATIONS).collect()) == expected
    nested = df.selectExpr("id", "array(text, 'key') as texts")
    rows = with_registered_hits(nested, "texts", "h", REGISTRATIONS, nested=True).collect()
    assert sum(len(x) for r in rows for x in r.h) == len(expected) + len(texts)


def test_policy_conditions_and_validation(spark):
    with pytest.raises(PolicyError):
        Policy((Rule(" ", 1, entity("secret"), "redact"),))
    with pytest.raises(PolicyError):
        Policy((Rule("a", 1, any_of(all_of(keyword("  ", "glob"))), "redact"),))
    with pytest.raises(PolicyError):
        Policy((Rule("a", 1, confidence("greater", 1.5), "redact"),))
    with pytest.raises(PolicyError):
        Policy((Rule("a", 1, keyword("x"), "redact", source="approval"),))
    assert len(BUILTIN.rules) == 12
    policy = BUILTIN.with_rules(
        operator_rule("o1", "redact", "One", "secret"),
        Rule("o2", 500, all_of(entity("secret"), keyword("Two")), "release", enabled=False, source="approval", category="secret"),
    )
    assert [r.text for r in policy.registrations()] == ["One"]
    assert sorted(policy.registered_texts()) == ["One", "Two"]
    assert [r.id for r in policy.rules[:2]] == ["o1", "o2"]


def test_globs(spark):
    from spanguard.operators.policy import matches

    cases = [
        ("a*c", "abbc", True), ("a?c", "a😀c", True), ("a?c", "ac", False), ("*", "", True), ("a.c", "abc", False),
        ("[ab]", "a", False), ("a*\n*b", "a x\ny b", True), ("A*", "abc", True), ("a\\*", "a\\x", True),
    ]
    df = spark.createDataFrame([(t,) for _, t, _ in cases], "word string").withColumn("n", F.monotonically_increasing_id())
    for pattern, text, expected in cases:
        got = df.where(F.col("word") == text).select(matches(keyword(pattern, "glob")).alias("m")).first().m
        assert got == expected, pattern


def test_pipeline_with_model_scorer(spark):
    def load():
        def model(texts):
            return [[("secret", 0.9, t.encode().index(b"zebra"), t.encode().index(b"zebra") + 5)] if "zebra" in t else [] for t in texts]

        return model

    df = spark.createDataFrame([(1, "é zebra-crossing and mail z@example.org"), (2, "nothing")], "id int, text string")
    rows = {r.id: r for r in run_pipeline(df, BUILTIN, scorer=ModelScorer(load, "m")).collect()}
    assert rows[1].redacted_text == "é <redacted_secret> and mail <redacted_private_email>"
    assert rows[2].redacted_text == "nothing"
    # Emails are recognized by shape alone: a scorer has no say there.
    lexicon = LexiconScorer((("nothing", "private_email", 0.99),))
    assert run_pipeline(df, BUILTIN, scorer=lexicon).where("id = 2").first().spans == []


def test_broken_scorers_fail_the_job(spark):
    df = spark.createDataFrame([("a text",)], "text string")
    for model in (lambda texts: [], lambda texts: [[("secret", 0.5, 0, 99)] for _ in texts], lambda texts: [[("secret", float("nan"), 0, 1)] for _ in texts]):
        with pytest.raises(Exception, match="scorer returned"):
            run_pipeline(df, BUILTIN, scorer=ModelScorer(lambda m=model: m, "bad")).collect()
