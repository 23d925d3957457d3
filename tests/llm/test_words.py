from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from speclake.llm import words as W


@pytest.mark.parametrize("piece", [1 << 21, 7])
@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_equal_the_pattern(monkeypatch, piece, kind):
    monkeypatch.setattr(W, "PIECE", piece)
    rng = random.Random(piece)
    parts = ["ab", "C", " ", "\n", "é", "-", "0", "日本", "\x0b", "long" * 9, "\x00"]
    texts = [None, "", " ", "x"] + [
        "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(200)
    ]
    for table, lower, pattern in (
        (W.SPACED, False, r"[^\x20\x09-\x0D]+"),
        (W.ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
    ):
        column = pa.array(["skipped", *texts], kind).slice(1)
        found = W.words_of(column, table, lower)
        fold = {c: c + 32 for c in range(65, 91)} if lower else {}
        seen = {}
        for i, text in enumerate(texts):
            want = re.findall(pattern, (text or "").translate(fold))
            rows = range(found.bounds[i], found.bounds[i + 1])
            got = [bytes(found.data[found.starts[k] : found.ends[k]]).decode() for k in rows]
            assert [g.translate(fold) for g in got] == want
            for k, w in zip(rows, want, strict=True):
                assert seen.setdefault(w, found.hashes[k]) == found.hashes[k]
        assert len(set(seen.values())) == len(seen)


def test_windows_do_not_depend_on_where_they_stand():
    words = W.words_of(pa.array(["a b c d e f g a b c d e"]), W.SPACED)
    for n in range(1, 6):
        hashes = W.window_hashes(words.hashes, n)
        assert len(hashes) == 13 - n and hashes[0] == hashes[7]
    assert len(W.window_hashes(words.hashes, 13)) == 0
