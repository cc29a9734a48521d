"""Exact copies, periodic runs and hard negatives against plain versions, on hard rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanguard.llm import exact, negatives, periodic, queries
from spanguard.llm.rows import table

SF = "/root/testdata/sf0.001"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

# --- exact copies -------------------------------------------------------------------------------------------------


def plain_groups(rows):
    """(id, text) rows: per row (id, keep_id, group size, digest), and of each group the rows that may stay."""
    groups = {}
    for doc_id, text in rows:
        text = text or ""
        key = hashlib.sha256("".join(c for c in text if c not in SPACES).encode()).hexdigest()
        groups.setdefault(key, []).append((-len(text), doc_id is None, doc_id or 0, doc_id))
    return [(r[3], min(g, key=lambda x: x[:3])[3], len(g), key) for key, g in groups.items() for r in g]


def copies(seed):
    rng = random.Random(seed)
    base = ["a b", "ab", "a\tb\n", "a b", "", " \r\n", None, "ß ß", "ßß", "\U0001f600 x", "x" * 50_000, "x " * 25_000, "A B"]
    rows = [(i, rng.choice(base)) for i in range(200)] + [(1000 + i, "hot " * (1 + i % 3)) for i in range(300)]
    rows += [(2000 + i, f"own {i}") for i in range(100)] + [(5, "a b"), (5, "a b"), (None, "ab"), (None, None), (None, "only null ids"), (None, "only null ids")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("winners", [exact.WINNERS, 2])
def test_exact_copies(spark, monkeypatch, winners):
    monkeypatch.setattr(exact, "WINNERS", winners)  # with two winners nearly all groups go the ordinary way
    rows = copies(3)
    got = exact.marked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(plain_groups(rows))
    per_group = Counter(r.text_sha256 for r in got if r.kept)
    assert set(per_group) == {r.text_sha256 for r in got} and set(per_group.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_frequent_digests_have_a_counter(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.col("id").alias("doc_id"))
    small = exact._digests(rows.repartition(7), F.monotonically_increasing_id(), "doc_id", "text")
    found = exact.frequent(small)
    hot = small.where(F.col("digest") == F.unhex(F.sha2(F.lit("hot").cast("binary"), 256))).select(F.xxhash64("digest").alias("short")).distinct()
    assert found.count() <= exact.WINNERS and found.join(hot, "short").count() == 1


def test_exact_copies_removed(spark):
    rows = copies(4)
    # Further columns named like the operator's own, or oddly.
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, row string, `odd.name` int")
    kept = exact.deduplicated(df)
    assert kept.schema == df.schema
    kept = kept.collect()
    expected = {(keep, digest) for _, keep, _, digest in plain_groups(rows)}
    assert len(kept) == len(expected) and {(k, d) for _, k, _, d in plain_groups([(r.doc_id, r.text) for r in kept])} == expected
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert exact.marked(nothing).count() == 0 and exact.deduplicated(nothing).count() == 0


def test_exact_copies_stay_in_the_jvm(spark):
    plan = queries.op13_exact_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- periodic runs ------------------------------------------------------------------------------------------------


def plain_runs(words, least=24, exponent=3):
    """Maximal stretches in which words q apart agree, for each q; of one stretch the smallest q."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, exponent * q):
                found.setdefault((start, i - start + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = (None,) * 4
    if runs:
        s, length, q = min(runs, key=lambda r: (-r[1] * 10**9 // r[2], r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_word_numbers():
    rng = random.Random(1)
    for _ in range(60):
        texts = []
        for _ in range(rng.randrange(1, 7)):
            n, kinds = rng.choice([0, 1, 2, 5, 30, 60, 200, 500]), rng.choice([1, 2, 3, 50])
            words = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3 + 1))
                words[a:] = [words[a + i % p] for i in range(n - a)]
            if n and rng.random() < 0.5:
                words[rng.randrange(n)] = 99
            texts.append(words)
        least, exponent = rng.choice([2, 5, 24]), rng.choice([2, 3, 4])
        got = periodic.runs_of([np.array(t, np.int64) for t in texts], least, exponent)
        assert [list(map(tuple, r.tolist())) for r in got] == [plain_runs(t, least, exponent) for t in texts]


def test_runs_of_all_equal_and_of_squarefree_words():
    assert periodic.runs_of([np.zeros(50_000, np.int64)])[0].tolist() == [[0, 50_000, 1]]
    cubefree = np.array([bin(i).count("1") & 1 for i in range(1 << 14)])  # Thue-Morse: many squares, no cube
    assert periodic.runs_of([cubefree], least_words=1)[0].tolist() == []
    assert periodic.runs_of([]) == [] and periodic.runs_of([np.zeros(0, np.int64)])[0].shape == (0, 3)


def test_a_lying_hash_is_noticed(monkeypatch):
    """With names of two bits nearly everything meets; the words themselves have the last say."""
    true = periodic._first_names
    monkeypatch.setattr(periodic, "_first_names", lambda ids, seed: true(ids, seed) & np.uint64(3) if seed < 3 else true(ids, seed))
    words = [*range(40), *([7, 8, 9] * 20), *range(100, 140)]
    got = periodic.runs_of([np.array(words)])[0].tolist()
    assert list(map(tuple, got)) == plain_runs(words)


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None, "a " * 30), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "x y\x0b" * 30), (5, "w" * 100_000), (6, "é à " * 12), (6, "é à " * 12)]
    rows += [(i, " ".join(rng.choice("abcdef") + str(rng.randrange(40)) for _ in range(rng.randrange(0, 300)))) for i in range(100, 400)]
    rows += [(i, rng.choice(["a b c ", "q ", "line one two\n"]) * rng.randrange(1, 60) + "end") for i in range(400, 460)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect())
    assert got == Counter(plain_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 40  # planted and natural ones


def test_periodic_runs_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 20_000]
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows) and [got[r[0]] for r in short] == [plain_row(*r) for r in short]


def test_collapsed_texts_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 20 + "c", "k")], "doc_id long, text string, lang string")
    row = periodic.with_runs(df).first()
    assert (row.n_words, row.collapsed, row.lang) == (41, "a b c", "k") and [tuple(r) for r in row.runs] == [(0, 40, 2)]
    assert periodic.with_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="taken"):
        periodic.with_runs(df.withColumn("runs", F.lit(1)))


# --- hard negatives -----------------------------------------------------------------------------------------------


def test_strassen():
    rng = np.random.default_rng(2)
    for shape in [(1, 1, 1), (3, 5, 7), (33, 64, 65), (70, 0, 5), (0, 4, 4), (129, 66, 100)]:
        a, b = rng.integers(-300, 300, shape[:2]), rng.integers(-300, 300, shape[1:])
        assert np.array_equal(negatives.strassen(a, b, leaf=4), a @ b)
    # Sums inside the recursion wrap here, the products do not.
    a = np.full((8, 8), 1 << 61) * (np.arange(8) == 0)
    b = np.eye(8, dtype=np.int64) * 3
    assert np.array_equal(negatives.strassen(a, b, leaf=1), a @ b)


def plain_negatives(rows, positives=5, count=5):
    usable = []
    for place, (key, label, vector) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if key is not None and key % 7 == 0:
            label = (label + 1) % 10
        usable.append((key, label, [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in vector], place))
    out = []
    for anchor in usable:
        if anchor[0] is None or anchor[0] % 100:
            continue
        scored = [(sum(x * y for x, y in zip(anchor[2], u[2])), u) for u in usable if u[3] != anchor[3] and len(u[2]) == len(anchor[2])]
        scored.sort(key=lambda s: (-s[0], s[1][0] is None, s[1][0] or 0))
        for p, positive in [s for s in scored if s[1][1] == anchor[1]][:positives]:
            window = [s for s in scored if s[1][1] != anchor[1] and 80 * p <= 100 * s[0] <= 100 * p][:count]
            out += [(anchor[0], positive[0], rank + 1, n[0], p, s) for rank, (s, n) in enumerate(window)]
    return out


def vectors(seed, n, size=12):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), [rng.gauss(0, 0.3) + 0.2 for _ in range(size)]) for i in range(n)]
    same = [0.5] * size
    rows += [(10_000 + i, i % 3, same) for i in range(120)]  # ties by the dozen, anchors among them
    rows += [(20_000, None, same), (20_100, 1, None), (20_200, 1, [float("nan")] * size), (20_300, 1, [None] * size), (20_400, 2, [float("inf")] * size)]
    rows += [(30_000, 1, []), (30_001, 1, []), (30_002, 2, []), (30_100, 3, [0.0] * size), (40_000, 1, [1.0, 2.0]), (40_001, 1, [1.0, 1.0]), (40_002, 2, [1.0, 1.0])]
    rows += [(None, 1, same), (None, 2, same), (-100, 1, [-0.4] * size)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, tmp_path, monkeypatch, small):
    if small:  # many blocks, groups, stripes and batches; deep recursion
        for name, value in [("BLOCK_BYTES", 300), ("GROUP_ROWS", 100), ("STRIPE", 2), ("BATCH", 16), ("LEAF", 2)]:
            monkeypatch.setattr(negatives, name, value)
    rows = vectors(5, 500)
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("row", F.lit("x")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(tuple(r) for r in queries.op11_hard_negatives(spark, str(tmp_path)).collect())
    assert got == Counter(plain_negatives(rows)) and sum(got.values()) > 50


def test_hard_negatives_with_one_key_twice_and_with_large_numbers(spark, tmp_path):
    ask = lambda rows: negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 100 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    # Components and sums beyond a long; what is returned fits.
    rows = [(100, 1, [0.0, 1.0, 1.0]), (100, 1, [0.0, 1.0, 1.0]), (1, 1, [1e290, 1.0, 1.0]), (2, 2, [1e290, 0.9, 0.95]), (3, 2, [-1e290, 1.0, 1.0])]
    rows += [(4, 2, [0.0, -1e290, 0.0]), (6, 1, [2.0**60, 2.0**40, 0.0]), (8, 3, [0.0, 2.0**39.9, 0.0]), (9, 3, [1e-300, 2.0**41, 0.0]), (10, 2, [5e15 + 1, 0.5, 0.4])]
    expected = plain_negatives(rows)
    assert len(expected) == 10 and all(abs(r[4]) < 2**63 for r in expected)
    assert Counter(tuple(r) for r in ask(rows).collect()) == Counter(expected)
    with pytest.raises(Exception, match="does not fit a long"):
        ask([*rows, (11, 1, [0.0, 1e290, 0.0])]).collect()


def test_hard_negatives_of_nothing(spark):
    nothing = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(nothing, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
    lonely = spark.createDataFrame([(100, 1, [1.0]), (1, 2, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(lonely, F.col("vec_id") % 100 == 0, F.col("label")).count() == 0
