from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from speclake.llm import pieces, token_ids
from speclake.llm.shared import shared_folder

PARTS = list("abcdeé日本▁  \n\t'<s>/0123.\u0000́ｱﬁ😀ßΣσςİ") + [
    "the", "ing", "  ", "<|endoftext|>", "<|ENDOFTEXT|>", "'RE", "ation", "\r\n", "\x1c", "\x85"
]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(vocabulary):
    some = [*texts(1, 1500), "", "x" * 500, "supercalifragilistic" * 40]
    found = [i.tolist() for i in vocabulary.encoded(some)[0]]
    assert found == vocabulary.library.encode(some, add_bos=True, add_eos=True)
    alone = [
        [1, *(i for w in vocabulary.cut(t) for i in vocabulary.merged(w)), 2]
        if t else [1, 2]
        for t in some
    ]
    assert alone == found


def test_pieces_table(documents):
    some = [*texts(2, 50), None, "same", "same", "long words " * 20_000]
    model = public_tokenizers.path("piece_bpe_32k.model")
    library = pieces.Pieces(model).library
    frame = documents(list(enumerate(some)))
    plain = {r.doc_id: r for r in pieces.encode(frame, model).collect()}
    short = {r.doc_id: r for r in pieces.encode(frame, model, digests=True).collect()}
    for k, t in enumerate(some):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(plain[k].ids, "<u4").tolist() == ids and plain[k].agrees
        assert plain[k].decoded == library.decode(ids) and short[k].n_tokens == len(ids)
        assert short[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert short[k].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode(documents([]), model).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    encoder = token_ids.Encoder(public_tokenizers.path(name))
    assert encoder.by_word == (name == "word_bpe_49k.json")
    some = texts(3, 1500)
    found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encoded(some)]
    assert found == [encoder._ids(t) for t in some]


@pytest.mark.parametrize(
    "values", [[5], [0], [0, 0, 0], [1, 1, 2, 900], [2**40, 2**40 + 5], list(range(0, 90_000, 17))]
)
def test_elias_fano(values):
    coded = token_ids.EliasFano.of(np.array(values))
    assert coded.all().tolist() == values and [coded[i] for i in range(len(values))] == values
    again, rest = token_ids.EliasFano.unpacked(memoryview(coded.packed() + b"xy"))
    assert again.all().tolist() == values and bytes(rest) == b"xy"


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 1000, 10_000))
    assert len(token_ids.EliasFano.of(ends).packed()) < 10_000 * 12 / 8


def test_round_trip(spark, documents, monkeypatch):
    monkeypatch.setattr(token_ids, "RANGE_BYTES", 2000)
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_ids.Encoder(path)
    rows = [(3 * i % 101 + 1000 * (i % 2), t) for i, t in enumerate(texts(4, 101))]
    rows += [(5000, None), (5001, "same"), (5001, "same"), (-7, "")]
    folder = shared_folder(spark)
    token_ids.write(documents(rows), path, 2, folder)
    found = token_ids.read(spark, folder, ids=True).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(k for k, _ in rows)
    start, by_key = 0, {}
    for k, t in rows:
        by_key.setdefault(k, []).append(encoder._ids(t or "") + [2])
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids) and ids in by_key[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(r.ids)
        start += r.n_tokens
    segment = token_ids.Segment.unpacked(spark.read.parquet(folder).first().segment)
    assert [len(segment.document(i)) for i in range(segment.ends.n)] == np.diff(
        [0, *segment.ends.all()]
    ).tolist()


def test_round_trip_null_keys_and_empty(spark, documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = token_ids.round_trip(documents([(4, "a"), (None, "b"), (None, None)]), path, 2)
    assert [r.doc_id for r in rows.orderBy("start").collect()] == [None, None, 4]
    assert token_ids.round_trip(documents([]), path, 2).collect() == []


def test_words_that_differ_get_the_library_ids(spark, documents):
    """A wrong union is found in whatever text has it, and does not get through."""
    vocabulary = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["the  house ", None, "", "▁a the", " the\0end\n", "house"]
    ids, agrees = vocabulary.encoded(texts, check=True)
    want = [vocabulary.library.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    assert [i.tolist() for i in ids] == want and all(agrees)
    known = vocabulary.known.young
    known["▁the"] = known["▁the"] * 2
    ids, agrees = vocabulary.encoded(texts, check=True)
    assert [i.tolist() for i in ids] == want and agrees == [False, True, True, False, True, True]


def test_plain_words_go_to_the_model_alone(monkeypatch):
    """New words of plain letters need no normalising or cutting, and have the library's ids."""
    encoder = token_ids.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.direct
    draw = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZàéíñóößøÿÀÉÑØ"
    words = [
        "".join(draw.choices(letters, k=draw.randint(1, 14))) + "".join(draw.choices(token_ids.MARKS, k=draw.randint(0, 5)))
        for _ in range(3000)
    ]
    odd = ["x́y", "İx", "ΑΣ", "ªº", "µm", "a×b", "ﬁn", "don't", "x1", "1", "Ǆ", "é", "中文", "<unk>", "a<b", "", "\xa0x"]
    want = [encoder._ids(w) for w in words + odd]
    got = [np.frombuffer(data, "<u4").tolist() for data in encoder._learnt(words + odd)]
    assert got == want
    assert encoder.encoded([" ".join(words + odd)])[0] == np.array(encoder._ids(" ".join(words + odd)), "<u4").tobytes()
    for mark in ("", ".", ",!"):
        encoder._learnt([f"a{mark}"])
    monkeypatch.setattr(encoder, "_ids", None)
    assert len(encoder._learnt(["neverseen", "Jamás.", "ñoño,!"])) == 3
