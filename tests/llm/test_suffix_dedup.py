from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from speclake.llm import suffix_dedup as S
from speclake.llm import words as W


def covered(words, n):
    """Places that lie in a run of n words which another document has."""
    held = defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            held[tuple(w[i : i + n])].add(d)
    out = {d: set() for d in words}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            if len(held[tuple(w[i : i + n])]) > 1:
                out[d].update(range(i, i + n))
    return out


def case(rng, size):
    voc = [f"w{i}" for i in range(size)]
    passages = [[rng.choice(voc) for _ in range(rng.randint(20, 90))] for _ in range(8)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(voc) for _ in range(rng.randint(0, 30))]
            p = rng.choice(passages)
            at = rng.randint(0, len(p) // 2)
            w += p[at : at + rng.randint(10, 90)]
        rows.append((d, " ".join(w)))
    again = " ".join(["a"] * 200)
    return [*rows, (90, None), (91, ""), (92, rows[3][1]), (93, rows[3][1]), (94, again), (95, again)]


@pytest.mark.parametrize(
    ("seed", "size", "least", "part"), [(5, 400, 50, 9), (6, 400, 34, 50_000), (7, 6, 50, 3)]
)
def test_against_brute_force(documents, monkeypatch, seed, size, least, part):
    monkeypatch.setattr(S, "PART", part)
    rows = case(random.Random(seed), size)
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    must, may = covered(words, least), covered(words, least - S.WINDOW + 1)
    found = {r.doc_id: r for r in S.report(documents(rows), least=least).collect()}
    assert set(found) == set(words)
    for d, r in found.items():
        got = {i for s in r.spans for i in range(s.start, s.end)}
        assert must[d] <= got <= may[d]
        assert r.n_repeated == len(got) and r.n_words == len(words[d])
        assert all(s.end - s.start >= least for s in r.spans)


def test_repeats_within_a_document_do_not_count(documents):
    once = " ".join(f"w{i}" for i in range(60))
    rows = S.report(documents([(1, once + " x " + once), (2, "short")])).collect()
    assert all(r.spans == [] for r in rows)
    same = S.report(documents([(1, once), (1, once)])).collect()
    assert [r.n_repeated for r in same] == [0, 0]
    assert S.report(documents([])).collect() == []


def test_every_window_has_a_minimiser():
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 50, n))) for n in (0, 10, 27, 28, 400)]
    words = W.words_of(pa.array(texts), W.SPACED)
    places = S.minimisers(words)
    for low, high in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        for i in range(low, high - S.WINDOW - S.RUN + 2):
            assert ((places >= i) & (places < i + S.WINDOW)).any()
