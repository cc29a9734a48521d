"""Packing, the token encoder and the token files against encoding every text as a whole."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spanguard.llm import binary, packing, tokens
from spanguard.llm.bytetext import NOT_SPACE, Hasher, words

PATH = tokens.public_path("word_bpe_49k.json")
PIECES = ["a", "b", "é", "e", "́", "'", "s", "t", "re", " ", "\n", ".", ",", "1", "23", "—", "Σ", "İ", "中", "😀", "-", ";", "=", "̸", "\x1c", " ", "<|endoftext|>", "<", "|", ">", "K", "ll", "\x85"]


def texts(n: int, seed: int = 1) -> list:
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 3, 10, 60]))) for _ in range(n)] + [None, "", "x" * 5000, "word " * 30000]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_ids_are_those_of_whole_texts(whole):
    given = texts(1500)
    ids, bounds = tokens.Encoder(PATH).encode(pa.array(given, pa.string()))
    for text, low, high in zip(given, bounds, bounds[1:]):
        assert ids[low:high].tolist() == whole(text).tolist(), text


def test_encoder_forgets_and_goes_on(whole, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 50)
    given = [f"w{i} x{i * 7} y" for i in range(12)] * 3
    encoder = tokens.Encoder(PATH)
    for text in given:
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == whole(text).tolist()


def test_words_across_small_chunks():
    given = texts(300, 5)
    want, _ = words(pa.array(given, pa.string()), NOT_SPACE, Hasher())
    parts = [words(pa.array([t], pa.string()), NOT_SPACE, Hasher())[0] for t in given]
    assert np.array_equal(want, np.concatenate(parts))


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_hilbert_neighbours(bits):
    side = np.arange(1 << bits)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part string, place string")


def rows_with_hard_cases():
    rows = [(i, t, "clash", "clash", None) for i, t in enumerate(texts(80, 3))]
    return [*rows, (5, rows[5][1], None, None, None), (None, "no id at all", None, None, None), (7, None, None, None, None)]


def test_packed_pieces(spark, whole):
    rows = rows_with_hard_cases()
    out = packing.packed(frame(spark, rows), PATH, length=64).collect()
    sequences, total = {}, 0
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        total += at
    sizes = [sum(x for _, x in sequences[i]) for i in range(len(sequences))]
    assert all(s == 64 for s in sizes[:-1]) and 0 < sizes[-1] <= 64
    assert total == sum(len(whole(r[1])) for r in rows)
    got: dict = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    for key in {r[0] for r in rows}:
        want = sorted(whole(r[1]).tobytes() for r in rows if r[0] == key)
        if len(want) == 1:
            assert b"".join(bytes(x) for _, x, _ in sorted(got[key])) == want[0]
            assert {n for _, _, n in got[key]} == {len(want[0]) // 4}
        else:
            assert sum(len(x) for _, x, _ in got[key]) == sum(map(len, want))


def test_packing_of_an_empty_table(spark):
    assert packing.packed(frame(spark, []), PATH).count() == 0


def test_token_files_round_trip(spark, whole, monkeypatch):
    monkeypatch.setattr(binary, "FRAME_IDS", 50)
    rows = rows_with_hard_cases()
    manifest = binary.written(frame(spark, rows), PATH)
    out = binary.read_back(manifest).collect()
    assert len(out) == len(rows)
    ordered = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
        assert r.ids_crc32 in {zlib.crc32(whole(x[1]).tobytes()) for x in rows if x[0] == r.doc_id}


def test_reader_reads_only_what_is_asked_and_checks_it(tmp_path):
    path = str(tmp_path / "x.zst")
    documents = [np.arange(i * 37 % 900) for i in range(200)] + [np.arange(600_000), np.zeros(0)]
    writer = binary.Writer(path)
    for ids in documents:
        writer.add(ids)
    assert writer.close() == (202, sum(map(len, documents)))
    reader = binary.Reader(path)
    for number in (201, 0, 200, 57, 199):
        assert reader.document(number).tolist() == documents[number].tolist()
    import zstandard

    data = open(path, "rb").read()
    plain = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert plain == np.concatenate(documents).astype("<u4").tobytes()  # any reader of the format skips index and seek table
    broken = bytearray(data)
    broken[int(reader.begins[3]) + 40] ^= 1
    open(path, "wb").write(bytes(broken))
    with pytest.raises(Exception):
        again = binary.Reader(path)
        for number in range(len(again)):
            again.document(number)


def test_token_files_of_an_empty_table(spark):
    assert binary.read_back(binary.written(frame(spark, []), PATH)).count() == 0
