import random

import pytest
from pyspark.sql import functions as F

from spanguard.operators.recognize import Recognizer, Recognizers, detect, is_credit_code, is_id_card
from tests import brute

CASES = [
    ("写信给lena@mail.example.org谢谢", [("private_email", "lena@mail.example.org")]),
    ("<lena@example.org>", [("private_email", "lena@example.org")]),
    ("git@host:path/repo", []),
    ("drwxr-xr-x@ 5 root", []),
    ("tool@4.5.6", []),
    ("a@b.com9@c.org", [("private_email", "a@b.com"), ("private_email", "9@c.org")]),
    ("x@a..com", []),
    ("call 13912345678 now", [("private_phone", "13912345678")]),
    ("a13912345678", []),
    ("12912345678 010-12345678", []),
    ("号13912345678。", [("private_phone", "13912345678")]),
    ("110105194912310021", []),
    ("11010519491231002X", [("id_card", "11010519491231002X")]),
    ("11010519491231002x.", [("id_card", "11010519491231002x")]),
    ("4111111111111111 4111111111111112 9111111111111111", [("bank_card", "4111111111111111")]),
    ("92440605MT7WQH4K20", [("credit_code", "92440605MT7WQH4K20")]),
    ("92440605MT7WQH4K21", []),
    ("8.8.4.4, 2606:4700:4700::1001", [("ip_address", "8.8.4.4"), ("ip_address", "2606:4700:4700::1001")]),
    ("127.0.0.1 10.1.2.3 169.254.0.9 240.0.0.1 192.0.2.7 100.64.0.1 ::1 fe80::1 2001:db8::7", []),
    ("8.8.8.256 8.8.8.8.8 08.8.8.8", []),
    ("::ffff:8.8.8.8", []),
    ("64:ff9b::808:808", [("ip_address", "64:ff9b::808:808")]),
    ("00:1b:44:11:3a:b7 00-1B-44-11-3A-B7 001b44113ab7", [("mac_address", "00:1b:44:11:3a:b7"), ("mac_address", "00-1B-44-11-3A-B7")]),
    ("x11:22:33:44:55:66:77", []),
    ("::00:1b:44:11:3a:b7", [("mac_address", "00:1b:44:11:3a:b7")]),
    ("", []),
    ("8.8.4.4", [("ip_address", "8.8.4.4")]),
    ("\x018.8.4.4\x01lena@example.org\x01", [("ip_address", "8.8.4.4"), ("private_email", "lena@example.org")]),
]


def scan(spark, texts, recognizers=None):
    rows = detect(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), recognizers=recognizers).collect()
    by_text = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r.id, r.start)):
        assert texts[r.id].encode()[r.start : r.end].decode() == r.word
        assert r.score == 1.0
        by_text[r.id].append((r.entity_group, r.word))
    return by_text


def test_literal_cases(spark):
    got = scan(spark, [t for t, _ in CASES])
    for (text, expected), actual in zip(CASES, got):
        assert actual == expected, text


def test_random_texts_match_brute_force(spark):
    rng = random.Random(7)
    pieces = [
        "a", "Z", "9", "1", "@", ".", "-", ":", "::", " ", "é", "中", "x.com", "b@c.de", "8.8.8.8", "1.2.3.4", "00:11:22",
        ":33:44:55", "13800138000", "4111111111111111", "2606:4700::", "ffff", "::1", "10.0.0.1", "\n", "_", "%", "+", "com", ".org",
        "\x01", "😀", "0", "256",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts += [" ".join(texts[:400]), "x@" + "a1." * 6000 + "com", "l" * 30000 + "@", "1." * 20000, "q@" + "a." * 20000]
    got = scan(spark, texts)
    for text, actual in zip(texts, got):
        assert actual == [(g, text[s:e]) for g, s, e in brute.found(text)], repr(text[:200])


def test_many_hits_in_one_text(spark):
    text = "\n".join(f"u{i}@x{i}.org from 8.8.{i % 250}.{i // 250 + 1}" for i in range(4000))
    assert len(scan(spark, [text])[0]) == 8000


def test_checksums_alone(spark):
    words = spark.createDataFrame([("11010519491231002X",), ("110105194912310020",), ("92440605MT7WQH4K20",), ("913",)], "w string")
    rows = words.select(F.expr(is_id_card("w")).alias("i"), F.expr(is_credit_code("w")).alias("c")).collect()
    assert [(r.i, r.c) for r in rows] == [(True, False), (False, False), (False, True), (False, False)]


def test_further_recognizer_joins_the_merge(spark):
    def plates(text):
        found = F.regexp_extract_all(text, F.lit(r"[A-Z]{2}-[0-9]{11}"), 0)
        def hit(w):
            start = F.call_function("locate", w, text) - 1
            return F.struct(
                F.lit("account_number").alias("entity_group"), F.lit(1.0).alias("score"), start.alias("start"),
                (start + F.octet_length(w)).alias("end"), w.alias("word"),
            )

        return F.transform(found, hit)

    extra = Recognizers([Recognizer("plates", "account_number", "authoritative", plates)])
    assert extra.kind_of("account_number") == "authoritative"
    assert Recognizers().kind_of("account_number") is None
    assert Recognizers().kind_of("private_phone") == "additive"
    got = scan(spark, ["plate AB-13800138000 and CD-99999999999"], extra)[0]
    # The mobile number inside the first plate is the more specific evidence.
    assert got == [("private_phone", "13800138000"), ("account_number", "CD-99999999999")]
    with pytest.raises(ValueError):
        Recognizers([Recognizer("bad", "nonsense", "additive", plates)])


def test_texts_fold_like_their_characters():
    """F4, F7 to F11: a whole text is folded at once, to what its characters fold to."""
    from spanguard.operators.registrations import _fold, _folded

    characters = [chr(i) for i in range(0x110000)]
    texts = ["".join(characters[i : i + 4096]) for i in range(0, 0x110000, 4096)] + ["ΟΔΟΣ İΣ Σ", "", "ABC"]
    assert all(_folded(t) == "".join(map(_fold, t)) for t in texts)
