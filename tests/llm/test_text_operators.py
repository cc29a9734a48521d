"""Personal data, decontamination, language, extraction, sharding and resampling against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanguard.llm import decontaminate, extract, language, pii, resampling, sharding
from spanguard.llm.queries import QUERIES

CLASH = "doc_id long, text string, pii string, runs string, items string, __x long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z", i) for i, t in texts], CLASH)


# --- personal data ------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    pieces = ["a", "b.c", "@", ".", "1", "23", "255", "256", "4111 1111 1111 1111", "79927398713", "4408041234567893", "+1 (555) 010-9999", " ", "-", "%", "é", "+", "(", ")", "\n", "x@y.z", "10.0.0.1", "00001"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        got = ",".join(f"{k}:{s}:{e}" for s, e, k, _ in pii.find(text) if k in BASE)
        assert got == plain_base(text), text


def test_checks_and_context_add_spans():
    kinds = lambda text: [(k, text[s:e]) for s, e, k, _ in pii.find(text)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay to DE89 3704 0044 0532 0130 01 now") == []
    assert kinds("call 415-555-0100 today") == [("tel", "415-555-0100")]
    assert kinds("part 415-555-0100 today") == []
    assert kinds("SSN 078-05-1120") == [("ssn", "078-05-1120")] and kinds("no 078-05-1120") == []
    near, far = pii.find("credit card 4408041234567893")[0][3], pii.find("4408041234567893")[0][3]
    assert near > far


def test_accounts_next_to_each_other_and_of_all_countries():
    accounts = lambda text: [text[s:e] for s, e, k, _ in pii.find(text) if k == "iban"]
    german, british = "DE89370400440532013000", "GB82WEST12345698765432"
    assert accounts(f"{german} {british}") == [german, british]
    assert accounts(f"{british} {german} {british}") == [british, german, british]
    assert pii.redact(f"{german} {british}.", pii.find(f"{german} {british}.")) == "<IBAN> <IBAN>."
    for code in ("AB12 CDEF GHIJ ", "DE12 ", "DE89 3704 0044 ", "XX00 1 2 3 "):
        assert accounts(code + german) == [german]
    assert accounts(german + "0") == accounts(german[:-1]) == accounts("X" + german) == []
    for country in ("SA03 8000 0000 6080 1016 7519", "AE07 0331 2345 6789 0123 456", "TR33 0006 1005 1978 6457 8413 26", "UA213223130000026007233566001",
                    "BR1800360305000010009795493C1", "LC55HEMM000100010012001200023015", "IL620108000000099999999"):
        assert accounts(f"to {country}, today") == [country]


def test_redaction_and_long_texts():
    assert pii.redact("mail a@b.cd or 10.0.0.1.", pii.find("mail a@b.cd or 10.0.0.1.")) == "mail <EMAIL> or <IP>."
    assert pii.redact(None, []) is None and pii.find(None) == [] and pii.find("") == []
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" * 150_000, "1 " * 150_000, "(" * 300_000, "A1" * 150_000):
        pii.find(text)  # each takes time linear in the text


def test_numbers_beside_many_spans():
    """Candidates are held against earlier spans in order, not against each of them."""
    lines = [f"a{i}@b.cd tel 415-555-{i % 10_000:04d} +1 (555) 010-{i % 10_000:04d} ssn 078-05-{i % 10_000:04d}" for i in range(20_000)]
    found = pii.find("\n".join(lines))
    assert Counter(k for _, _, k, _ in found) == {"email": 20_000, "tel": 20_000, "phone": 20_000, "ssn": 20_000}


def test_spans_keep_rows_and_columns(spark):
    out = pii.with_spans(frame(spark, [(1, "a@b.cd"), (1, "a@b.cd"), (2, None), (None, "")]), spans="found").collect()
    assert sorted(len(r.found) for r in out) == [0, 0, 1, 1] and all(r.pii == "x" for r in out)
    assert pii.with_spans(frame(spark, []), spans="found").count() == 0


# --- decontamination ----------------------------------------------------------------------------------------------


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_hits(text, items, length):
    w, hit, names = word_list(text), set(), set()
    for name, item in items:
        v = word_list(item)
        n = min(length, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1 if v else 0):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add("" if name is None else str(name))
    return len(w), len(hit), sorted(names)


@pytest.mark.parametrize("shard_bytes", [1 << 24, 300])
def test_hits_are_those_of_all_windows(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard_bytes)
    rng = random.Random(shard_bytes)
    say = lambda n: " ".join(rng.choice(["a", "b", "ç", "D", "7"]) for _ in range(n))
    items = [(i, say(rng.choice([3, 4, 9, 14]))) for i in range(12)] + [(12, None), (13, ""), (14, "..."), (3, "a b ç"), (None, "d d d 7")]
    texts = [(i, say(rng.choice([0, 1, 5, 40, 200]))) for i in range(120)] + [(200, None), (200, items[0][1]), (None, items[1][1]), (7, "b; " * 3000 + items[2][1])]
    tests = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.matched(frame(spark, texts), tests, length=6)
    hit = decontaminate.covered_words()
    got = Counter((r.doc_id, r["__words"], r.hit, tuple(r["__items"])) for r in out.withColumn("hit", hit).collect())
    want = Counter((i, n, h, tuple(names)) for i, t in texts for n, h, names in [plain_hits(t, items, 6)])
    assert got == want


def test_many_equal_short_items_take_little_memory():
    import tracemalloc

    rng = random.Random(3)
    items = [(str(i), "one") for i in range(10_000)] + [(f"long{i}", " ".join(["one"] + [f"w{rng.randrange(20_000)}" for _ in range(200)])) for i in range(200)]
    tracemalloc.start()
    index = decontaminate.Index(items, 10)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 20e6
    first = [int(x) for x in index.numbered(decontaminate.words(pa.array(["one"]), decontaminate.ALPHANUMERIC, decontaminate.Hasher())[0])]
    covered, known = index.automaton.hits(first)
    assert covered == [(0, 1)] and [len(index.names[n]) for n in known] == [10_000]


def test_covered_passages_are_cut_out(spark):
    tests = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    texts = [(1, "Héllo, One two THREE four five!  and more than enough words stay"), (2, "one two three four five six"), (3, None), (4, ""), (5, "nothing here")]
    out = {r.doc_id: r.text for r in decontaminate.decontaminated(frame(spark, texts), tests, length=5).collect()}
    assert out == {1: "Héllo, !  and more than enough words stay", 3: None, 4: "", 5: "nothing here"}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(frame(spark, texts), empty, length=5).count() == 5


def test_long_documents_keep_their_clean_words(spark, tmp_path):
    import corpus_pipeline

    items = [" ".join(f"item{i}word{k}" for k in range(60)) for i in range(5)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [" ".join(f"w{(i * 7919 + k) % 9973}" for k in range(4000)) for i in range(5)]
    texts = [(1, " ".join(x for pair in zip(clean, items) for x in pair)), (2, items[0] + " and few words"), (3, clean[0])]
    out = {r.doc_id: r.text for r in corpus_pipeline.without_benchmarks(spark, frame(spark, texts), str(tmp_path)).collect()}
    assert sorted(out) == [1, 3] and out[1].split() == " ".join(clean).split() and out[3] == clean[0]


# --- language -----------------------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    held = [r for r in QUERIES["op6_language"](spark, d).collect() if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in held)


def test_scores_are_those_of_counted_grams(spark):
    rows = [("ab ba", "x"), ("cd dc!", "y"), (None, "x"), ("ab", None), ("Ünï 中文", "y")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["x", "y"]

    def grams(text):
        import numpy as np

        folded = "".join(c.lower() if c.isalpha() else " " for c in text)
        folded = " " + re.sub(" +", " ", folded).lstrip() if folded.startswith(" ") else " " + re.sub(" +", " ", folded)
        folded = re.sub(" +", " ", " " + folded.lstrip(" ")) if not text[:1].isalpha() else folded
        codes = np.array([ord(c) for c in folded], np.uint32)
        return [int(b) for order in language.ORDERS if len(codes) >= order for b in language.grams(codes, order)]

    import pyarrow as pa

    texts = ["ab cd", "zz", "ünï ab"]
    totals, lettered = model.scores(pa.array(texts))
    for text, row in zip(texts, totals):
        for k in range(2):
            assert abs(sum(model.logs[k][b] for b in grams(text)) + model.priors[k] - row[k]) < 1e-9
    assert lettered.all()
    names, scores = model.predict(pa.array([None, "", "123 !", "ab"]))
    assert names[:3] == ["und"] * 3 and scores[:3].tolist() == [0, 0, 0] and names[3] == "x"
    batch, _ = model.scores(pa.array(texts * 50_000))
    assert abs(batch[-3:] - totals).max() < 1e-6


def test_without_training_rows_nothing_is_known(spark):
    docs = frame(spark, [(1, "abc"), (2, None)])
    model = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert [r.p.lang for r in docs.select(language.predicted(docs, model).alias("p")).collect()] == ["und", "und"]


# --- pages --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>menu</a></nav>", ""),
        ("<body><article><h1>T &amp; t</h1><p>a <b>b</b>\n c<br>d</article><footer>f</footer>", "T & t\na b c d"),
        ("<article><p>x<script>if (a<b) '</p>'</script> y<!-- <p>no --></p><form><p>no</form><p>z</article>", "x y\nz"),
        ("<main><div class='sidebar left'><p>no</div><p>yes<div class=\"comment-list\"><article>no</article></div></main>", "yes"),
        ("<p>" + "long text of a page without marks " * 5 + "</p><ul><li><a>home</a><li><a>more</a></ul>", ("long text of a page without marks " * 5).strip()),
        ("a < b & c &lt; d", "a < b & c < d"),
        ("<article><p title='a > b'>one</p><p title=\"broken>two</p></article>", "one\ntwo"),
        ("<div class=cookie-notice>We use cookies</div><article><p>only</p></article>", "only"),
    ],
)
def test_main_text(page, text):
    assert extract.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>T</h1><p>a<p class='ad'>buy<p>b<p>c</article>", "T\na\nb\nc"),
        ("<article><div><p class='ad'>buy</div><p>b</article>", "b"),
        ("<article><ul><li class='ad'>buy<li>b<li>c</ul><p>d</article>", "b\nc\nd"),
        ("<article><dl><dt class='ad'>buy<dd>b<dt>c</dl></article>", "b\nc"),
        ("<article><table><tr class='ad'><td>buy<tr><td>b<td class='ad'>buy<td>c</table></article>", "b\nc"),
        ("<article><ul><li class='ad'>buy<ul><li>buy<li>buy</ul>buy<li>b</ul></article>", "b"),
        ("<head><meta charset=utf-8><body><article><p>a</article>", "a"),
        ("<article><svg class='icon'/><p>a</p><svg/><p>b</p><svg><path/><g><title/></g></svg><p>c</article>", "a\nb\nc"),
        ("<article><svg><p>a</p></article>", "a"),
    ],
)
def test_omitted_end_tags_end_what_is_skipped(page, text):
    assert extract.main_text(page) == text


LONG = "A sentence of the story that goes on for some time, as sentences of stories do. " * 2


@pytest.mark.parametrize("wrapped", [
    "<body class='single comments-open'>{}</body>",
    "<body class='comments'>{}</body>",
    "<main class='has-comments'>{}</main>",
    "<main class='comments'>{}</main>",
    "<article class='post category-social'>{}</article>",
    "<article class='post tag-header ad'>{}</article>",
    "<article><header class='entry-header'>{}</header></article>",
    "<article><header class='header'>{}</header></article>",
    "<div class='layout has-sidebar'>{}</div>",
    "<div class='sidebar'><article>{}</article></div>",
    "<div id='discussion'><main>{}</main></div>",
    "<div class='widget'>{}</div><p>rest</p>",
])
def test_names_do_not_erase_the_main_text(wrapped):
    assert f"Title\n{LONG.strip()}" in extract.main_text(wrapped.format(f"<h1>Title</h1><p>{LONG}</p>"))


@pytest.mark.parametrize("name", ["comments", "comment-list", "commentlist", "sidebar left", "ad-300x250", "site-footer", "cookie-notice", "side-bar"])
def test_named_elements_go(name):
    assert extract.main_text(f"<p>{LONG}<div class='{name}'><p>short</div><p>{LONG}") == f"{LONG.strip()}\n{LONG.strip()}"
    assert extract.main_text(f"<article><p>{LONG}<span id='{name}'>short</span><p>{LONG}</article>") == f"{LONG.strip()}\n{LONG.strip()}"


def test_text_lengths_decide_on_pages_with_articles():
    body = [f"{i} {LONG}".strip() for i in range(5)]
    page = "<div><h1>The title of the page</h1>" + "".join(f"<p>{x}</p>" for x in body) + "</div>"
    for teaser in ("<article><h3>Latest</h3><p>Short teaser.</p></article>", "<main><p>Short teaser.</p></main>"):
        for whole in (teaser + page, page + teaser):
            got = extract.main_text(whole).split("\n")
            assert [x for x in got if "Latest" not in x and "teaser" not in x] == ["The title of the page", *body]
    links = "<ul>" + "<li><a href=x>A link to another story of the day</a>" * 4 + "</ul>"
    assert extract.main_text(f"<div>Weather 12</div><article><h1>T</h1><p>{LONG}{links}</article><div>All rights</div>") == f"T\n{LONG.strip()}"


NOTICE = "<div class='cookie-notice'><p>" + "We use cookies on this site. " * 14 + "</p></div>"  # 410 characters
ASIDE = "<div class='sidebar'><p>" + "About the author and so on " * 19 + "</p></div>"  # 500
READERS = "<div id='comments'><p>" + "A reader says this " * 82 + "</p></div>"  # 1,560


@pytest.mark.parametrize("block", ["<article>{}</article>", "<div>{}</div>", "<main>{}</main>", "<div><section>{}</section></div>", "{}"])
def test_whole_article_and_nothing_beside_it(block):
    linked = "<p><a href=x>Read the whole of the original report here</a></p>"
    parts = ["<h1>Title</h1>", "<p>One.</p>", "<p>Two.</p>", "<p>Three.</p>", f"<p>{LONG}</p>", linked, f"<p>{LONG}</p>", linked * 3, "<p>End.</p>"]
    text = "\n".join(x.strip() for x in re.split(r"<[^>]*>", "".join(parts)) if x.strip())
    menu = "<div><ul>" + "<li><a href=x>menu</a></li>" * 5 + "</ul></div>"
    tail = "<div class='site-info'>Some site</div><div class='x'>© 2024 Some site</div>"
    assert extract.main_text(f"<html><body>{NOTICE}{menu}{block.format(''.join(parts))}{ASIDE}{READERS}{menu}{tail}</body></html>") == text
    inner = "".join(parts[:5]) + NOTICE + ASIDE + READERS + "".join(parts[5:])
    assert extract.main_text(f"<body>{menu}{block.format(inner)}{menu}</body>") == text


@pytest.mark.parametrize("filler", [100, 2_100, 100_000])
def test_attributes_are_read_whole(filler):
    odd = f"<div title='x\" {'a=b ' * (filler // 4)} class=\"sidebar\">side</div>"
    for page in ("<article><p>{0}</p>{1}<p>b</p></article>", "<div><p>{0}</p>{1}<p>b</p></div>"):
        assert extract.main_text(page.format(LONG, odd)) == f"{LONG.strip()}\nb"


def test_stretches_are_those_of_all_windows():
    """Line-block distribution written plainly: a line is text if some window began to surge at or before it, without a dive since."""
    rng = random.Random(9)
    for _ in range(400):
        weights = [rng.choice([0, 0, 3, 10, 25, 70, 200]) for _ in range(rng.randrange(0, 25))]
        sums = [sum(weights[i : i + extract.WINDOW]) for i in range(len(weights))]
        want = []
        for i, weight in enumerate(weights):
            surges = [j for j in range(i + 1) if weights[j] and sums[j] >= extract.SURGE]
            want.append(bool(weight and any(all(sums[k] for k in range(j, i + 1)) for j in surges)))
        if not any(want) and any(sums):
            best = sums.index(max(sums))
            want = [best <= i < best + extract.WINDOW and w > 0 for i, w in enumerate(weights)]
        assert extract.stretches(weights) == want


def test_deep_pages_take_linear_time():
    for page in ("<div>" * 50_000, "<p><table><td>" + "<div>" * 50_000, "<li><b>" * 50_000, "<div><p class=ad>" * 50_000, "<article>" * 50_000 + "</b>" * 50_000, "<b>" * 50_000 + "</div>" * 50_000):
        extract.main_text(page)


def test_long_pages_take_linear_time():
    for page in ("<p " * 100_000, "<a b='" * 100_000, "<!--" * 100_000, "<script>" * 100_000, "&amp;" * 200_000, "<div class=ad>" * 50_000, "<p>x" * 100_000):
        extract.main_text(page)


def test_articles_of_the_given_pages(spark):
    import html

    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in QUERIES["op4_main_text"](spark, d).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- sharding -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 24, 97, 1000])
def test_permutation(spark, n):
    place = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7)).collect()]
    assert sorted(place) == list(range(n))
    if n > 90:
        assert place != sorted(place) and sum(abs(a - b) == 1 for a, b in zip(place, place[1:])) < n / 5


def test_shards_are_even_and_repeatable(spark):
    rows = [(i % 50 if i % 7 else None, f"t{i % 5}") for i in range(301)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("number", F.lit("clash"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    one = sharding.sharded(df, order, 24, 3).collect()
    other = sharding.sharded(df.repartition(7), order, 24, 3).collect()
    assert Counter(map(tuple, one)) == Counter(map(tuple, other))
    counts = Counter(r.shard for r in one)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in one if r.shard == s) == list(range(n)) for s, n in counts.items())
    assert sharding.sharded(df.limit(0), order, 24).count() == 0


# --- resampling ---------------------------------------------------------------------------------------------------


def test_weights_follow_the_target(spark):
    rows = [(i, "good clean words here" if i % 2 else "bad foul noise there") for i in range(200)] + [(None, "good"), (300, None), (301, "")]
    docs = frame(spark, rows)
    target = spark.createDataFrame([(i,) for i in range(1, 60, 2)] + [(None,), (1,)], "doc_id long")
    out = resampling.resampled(docs, target, fraction=0.4, seed=1).collect()
    assert len(out) == len(rows) and sum(r.kept for r in out) == round(0.4 * len(rows))
    assert sorted(r["rank"] for r in out) == list(range(len(rows)))
    weights = {r.doc_id: (r.log_weight, r.n_grams) for r in out}
    assert weights[1][0] > 1 > -1 > weights[2][0] and weights[1][1] == 7 and weights[300] == (0, 0) == weights[301]
    again = resampling.resampled(docs.repartition(5), target, fraction=0.4, seed=1).collect()
    assert {r.doc_id: r.kept for r in out} == {r.doc_id: r.kept for r in again}
    assert resampling.resampled(docs.limit(0), target).count() == 0


def test_resampling_against_plain_counts(spark):
    """Weights from counts of words and pairs made one by one; ranks and kept rows from the keys."""
    rng = random.Random(12)
    say = lambda n, word: " ".join(rng.choice(["Alpha", "beta", "Ç7", word, f"{word}{rng.randrange(9)}"]) for _ in range(n))
    rows = [(i, say(rng.randrange(0, 30), "good" if i % 3 else "bad")) for i in range(150)] + [(None, "good beta"), (500, None), (501, "!!"), (7, "twice good")]
    target = [i for i in range(0, 150) if i % 3 and i % 2] + [7]
    grams, where = {}, lambda text: resampling.bins(pa.array([text]))[0].tolist()
    for _, text in rows:
        w = word_list(text)
        for gram in [*w, *zip(w, w[1:])]:
            if gram not in grams:
                grams[gram] = where(gram)[0] if isinstance(gram, str) else where(" ".join(gram))[2]
    listed = [[grams[g] for g in [*w, *zip(w, w[1:])]] for w in (word_list(t) for _, t in rows)]
    raw, wanted = Counter(b for bins in listed for b in bins), Counter(b for (key, _), bins in zip(rows, listed) for b in bins if key in set(target))
    n, m = sum(raw.values()), sum(wanted.values())

    def ratio(b):
        share = (raw[b] + 0.5) / (n + 0.5 * resampling.BINS)
        return math.log((wanted[b] + resampling.PRIOR * share) / (m + resampling.PRIOR) / share)

    out = resampling.resampled(frame(spark, rows), spark.createDataFrame([(i,) for i in target], "doc_id long"), fraction=0.3, seed=5).collect()
    plain = sorted((str(key), len(bins), round(sum(map(ratio, bins)), 9)) for (key, _), bins in zip(rows, listed))
    assert sorted((str(r.doc_id), r.n_grams, round(r.log_weight, 9)) for r in out) == plain
    ranked = sorted(out, key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(len(rows))) and all(a.gumbel_key >= b.gumbel_key for a, b in zip(ranked, ranked[1:]))
    assert [r.kept for r in ranked] == [i < round(0.3 * len(rows)) for i in range(len(rows))]
    noise = sorted(math.exp(-math.exp(r.log_weight - r.gumbel_key)) for r in out)  # uniform if the noise is Gumbel's
    assert max(abs(u - (i + 0.5) / len(noise)) for i, u in enumerate(noise)) < 0.15 and len(set(noise)) == len(noise)


# --- registered queries -------------------------------------------------------------------------------------------


def test_query_columns_of_personal_data_and_decontamination(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in QUERIES["op7_personal_data"](spark, d).collect():
        assert r.base_sha256 == hashlib.sha256(plain_base(texts[r.doc_id]).encode()).hexdigest()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    for r in QUERIES["op9_decontamination"](spark, d).collect():
        n, hit, names = plain_hits(texts[r.doc_id], items, 10)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
