"""Joins over pairs, components and the pipeline against plain versions."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanguard.llm import graph, jaccard, packing, tokens, vectors


def least_of_groups(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == least_of_groups({x for e in real for x in e}, real)
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- n-gram join --------------------------------------------------------------------------------------------------


def plain_sets(texts, width):
    out = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def linked(a, b, least):
    return bool(a) and bool(b) and 100 * len(a & b) >= least * len(a | b)


def families(seed, groups, copies, longest=120):
    """Texts with copies of all degrees of likeness, and pieces that many share."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    shared = [word() for _ in range(30)]
    out = [None, "", " \n", "one", "One", "one two", "one two three", "x" * 3000]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(4, longest))]
        if rng.random() < 0.4:
            base += shared
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text = text[rng.randrange(3) :]
            out.append(rng.choice([" ", "\n"]).join(text))
    return out


@pytest.mark.parametrize(("width", "least", "block"), [(4, 85, 64), (5, 80, 4)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, width, least, block):
    monkeypatch.setattr(jaccard, "LEAST_BLOCK", block)
    texts = families(width, 60, 9)
    rows = [(i, t, i, "clash", "clash") for i, t in enumerate(texts)]
    rows += [(3, texts[20], 0, "", ""), (None, texts[20], 0, "", ""), (None, "all alone with no number here", 0, "", ""), (None, None, 0, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long, node string, elements string")
    sets = plain_sets([r[1] for r in rows], width)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if linked(sets[i], sets[j], least)]
    groups = least_of_groups(range(len(rows)), links)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[groups[i]].append(r[0])
    want = Counter((r[0], len(sets[i]), min(ids[groups[i]], default=None)) for i, r in enumerate(rows))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(df, width=width, least=least).collect())
    assert got == want
    assert len(links) > 100


def test_join_of_an_empty_table(spark):
    assert jaccard.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("least", [60, 80, 85, 95])
def test_linked_sets_share_a_key(least):
    """The promise of the blocks: sets that link always share a key, at the very edge of the threshold too."""
    rng = np.random.default_rng(least)
    firsts = jaccard.size_classes(1 << 40, least)
    for _ in range(600):
        s = int(rng.integers(1, 400))
        base = rng.integers(0, 1 << 63, s, dtype=np.uint64)
        most = int((100 - least) * s / 100)
        gone = int(rng.integers(0, most + 1))
        new = int(rng.integers(0, most - gone + 1))
        a = np.unique(base)
        b = np.unique(np.concatenate([base[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
        if linked(set(a.tolist()), set(b.tolist()), least) and not np.array_equal(a, b):
            assert set(jaccard.keys_of(a, firsts, least).tolist()) & set(jaccard.keys_of(b, firsts, least).tolist())


def test_merge_skip_counts():
    rng = random.Random(8)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randrange(0, 20))) for _ in range(rng.randrange(1, 9))]
        need = rng.randrange(1, 5)
        counts = Counter(x for one in lists for x in one)
        assert dict(jaccard.merge_skip(lists, need)) == {x: c for x, c in counts.items() if c >= need}


def test_divide_skip_finds_every_group_with_and_without_sides():
    for seed in range(6):
        texts = [t for t in families(seed, 12, 9, 60) if t and t.strip()]
        sets = sorted({frozenset(s) for s in plain_sets(texts, 3)}, key=len)
        hashed = [np.array(sorted(hash(x) & (1 << 63) - 1 for x in s), np.uint64) for s in sets]
        sides = [i % 2 for i in range(len(sets))]
        for kept in (None, sides):
            links = [(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j], 70) and (kept is None or kept[i] != kept[j])]
            got = jaccard.divide_skip(hashed, kept, 70)
            assert set(got) <= {(j, i) for i, j in links}
            assert least_of_groups(range(len(sets)), got) == least_of_groups(range(len(sets)), links)


# --- vectors ------------------------------------------------------------------------------------------------------


def test_vectors_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAST_BLOCK", 16)
    monkeypatch.setattr(vectors, "STRIPE", 5)
    rng = np.random.default_rng(2)
    rows: list = []
    for _ in range(25):
        base = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((base + rng.normal(size=32) * rng.choice([0, 0.1, 0.35, 0.45, 0.6])).astype(np.float32) * np.float32(rng.choice([1, 1e-3, 50])))
    rows += [rows[0], rows[0], rows[1] * 2, np.ones(8, np.float32), np.ones(8, np.float32) * 3, np.float32([1] + [0] * 31)]
    table = [(i, [float(x) for x in v], "x", 1) for i, v in enumerate(rows)]
    n = len(table)
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0, float("inf")] + [0.0] * 30, [None] + [1.0] * 31]
    table += [(n + i, v, "x", 1) for i, v in enumerate(odd)] + [(None, table[5][1], "x", 1), (5, table[5][1], "x", 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, node string, component long")
    good = [i for i, r in enumerate(table) if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = []
    for a in good:
        for b in good:
            if a < b and len(table[a][1]) == len(table[b][1]):
                u, v = np.float32(table[a][1]).astype(float), np.float32(table[b][1]).astype(float)
                if u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9:
                    links.append((a, b))
    degree = Counter(x for e in links for x in e)
    groups = least_of_groups(range(len(table)), links)
    ids = defaultdict(list)
    for i, r in enumerate(table):
        if r[0] is not None:
            ids[groups[i]].append(r[0])
    names = [min(ids[groups[i]], default=None) for i in range(len(table))]
    want = Counter((r[0], degree[i], names[i], r[0] == names[i]) for i, r in enumerate(table))
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert got == want and len(links) > 50


def test_tiny_and_huge_vectors_hide_no_links(spark):
    """Squares of these run under or over in double precision; nobody loses a link by it."""
    rows = [[1.0, 2.0], [1.0, 2.0000001], [1e-200, 2e-200], [1e200, 2e200], [1e-310, -1e-310], [3.0, -3.0], [1e300, -1.1e300], [0.0, 5e-324], [0.0, 1.0], [-1.0, 0.0]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    exact = [[Fraction(x) for x in v] for v in rows]
    links = []
    for i, a in enumerate(exact):
        for j, b in enumerate(exact[:i]):
            product = sum(x * y for x, y in zip(a, b))
            if product > 0 and product**2 >= Fraction(81, 100) * sum(x * x for x in a) * sum(x * x for x in b):
                links.append((j, i))
    degree, groups = Counter(x for e in links for x in e), least_of_groups(range(len(rows)), links)
    assert got == {i: (degree[i], groups[i]) for i in range(len(rows))} and len(links) > 5


def test_error_bounds_hold():
    rng = np.random.default_rng(3)
    units = rng.normal(size=(400, 48)) * rng.choice([1, 30], size=(400, 48))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    q, s, e = vectors.quantised(units)
    product = (q.astype(float) @ q.astype(float).T) * s[:, None] * s[None, :]
    assert (np.abs(product - units @ units.T) <= e[:, None] + (1 + e[:, None]) * e[None, :] + 1e-12).all()


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- pipeline -----------------------------------------------------------------------------------------------------

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node string, __x long"


def test_stages_on_hard_rows(spark):
    d = "/root/testdata/sf0.001"
    real = [r.text for r in spark.read.parquet(f"{d}/documents.parquet").where("lang = 'en'").limit(30).collect()]
    item = next(r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if len(r.text.split()) > 15)
    rows = [(i, t, "en", "s", len(t), "n", 1) for i, t in enumerate(real)]
    rows += [(100, real[0], "en", "s", 1, "n", 1), (0, real[0], "en", "s", 1, "n", 1), (101, None, "en", None, None, None, None), (102, "", None, "s", 0, "n", 1), (103, "12 34 ...", "en", "s", 9, "n", 1)]
    rows += [(104, item, "en", "s", 1, "n", 1), (105, real[1] + "\n" + item, None, "s", 1, "n", 1), (None, real[2], "en", "s", 1, "n", 1), (106, real[3] + " write to some.body@mail.example.org", "en", "s", 1, "n", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows_} for name, rows_ in seen.items()}
    assert not ids["language"] & {101, 102, 103} and set(range(30)) | {104, 105, 106, None} <= ids["language"]
    assert 100 not in ids["ngram_join"] and sum(r.doc_id == 0 for r in seen["ngram_join"]) == 1 and None in ids["ngram_join"]
    assert 104 not in ids["decontamination"] and ids["ngram_join"] - ids["decontamination"] <= {104}
    text = {r.doc_id: r for r in seen["personal_data"]}
    assert all("@" not in r.text for r in text.values()) and all(r.n_chars == len(r.text) for r in text.values())
    if 105 in text:
        assert item not in text[105].text
    encoder = tokens.Encoder(tokens.public_path("word_bpe_49k.json"))
    import pyarrow as pa

    want = sum(len(encoder.encode(pa.array([r.text]))[0]) for r in seen["personal_data"])
    assert sum(r.length for r in seen["packing"]) == want and ids["packing"] == ids["personal_data"]


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert packing.packed(docs, tokens.public_path("word_bpe_49k.json")).count() == 0


def test_run_is_the_stages_in_order(spark):
    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    sizes = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sorted(r.n for r in sizes)[1:] == [2048] * (len(sizes) - 1)


def test_bitmaps_never_differ_more_than_their_sets():
    rng = np.random.default_rng(9)
    for _ in range(60):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 3000)), dtype=np.uint64)
        a = np.unique(base)
        b = np.unique(np.concatenate([base[int(rng.integers(0, len(base))) :], rng.integers(0, 1 << 63, int(rng.integers(1, 900)), dtype=np.uint64)]))
        x, y = jaccard.folded([jaccard.bitmap(a), jaccard.bitmap(b)])
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        pairs = [z for c, d in jaccard.possible_pairs(x[None], np.array([len(a)]), y[None], np.array([len(b)]), 80) for z in zip(c, d)]
        if linked(set(a.tolist()), set(b.tolist()), 80):
            assert pairs == [(0, 0)]


@pytest.mark.parametrize("least", [60, 80, 85, 95])
def test_linked_sizes_lie_in_neighbouring_bands(least):
    import math

    step = math.log(100 / least) * 1.0001
    for s in range(1, 20_000):
        assert math.floor(math.log(100 * s // least) / step) - math.floor(math.log(s) / step) <= 1
