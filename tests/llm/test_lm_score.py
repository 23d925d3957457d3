from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import pairwise
from zlib import crc32

import numpy as np
import pytest

from speclake.llm import lm_score, recurrent


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held(doc_id):
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def base(rows):
    """n_tokens, n_known, N and the base score of each row, by definition."""
    c = Counter(w for k, t in rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [
        (
            held(k), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
            sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)),
        )
        for k, t in rows
    ]


def some_rows():
    rng = random.Random(9)
    words = ["The", "the", "a", "É", "é", "Zürich", "b-c", "long" * 40, "LONG" * 40, "\x00", "x"]
    words += [f"w{i}" for i in range(60)]
    rows = [(None, "the a"), (None, None), (0, ""), (1, " \t"), (2, None)]
    rows += [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 40])))) for k in range(3, 120)]
    rows += [(k, f"only in number {k} " * 3) for k in range(200, 230)]
    rows += [(7, rows[9][1]), (7, rows[9][1]), (300, "word " * 5_000)]
    held_words = [(k, "unheard " * 9) for k in range(400, 440) if held(k)]
    return rows + held_words


@pytest.mark.parametrize("heavy", [4, 1 << 16])
def test_base_equals_brute_force(spark, documents, heavy):
    rows = some_rows()
    found = lm_score.report(documents(rows), heavy, 8).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got = sorted([(r.doc_id, *tuple(r)[1:6]) for r in found], key=key)
    want = sorted([(k, *b) for (k, _), b in zip(rows, base(rows), strict=True)], key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * abs(w[5]) + 1e-9 for g, w in zip(got, want, strict=True))


def test_scores_are_those_of_the_model(spark, documents):
    """Each text alone, token by token, with all outputs of the model and the counts in plain sight."""
    rows = some_rows()
    docs = documents(rows)
    counts = lm_score.staged(lm_score.word_counts(docs))
    known = lm_score.lexicon(counts, 6, 8)
    p = recurrent.unflat(
        lm_score.fit(docs, known), recurrent.initial(known.shape, np.ones(known.shape.symbols))
    )
    c = Counter()
    for k, t in rows:
        c.update(lm_score._words(t) if not held(k) else [])
    own = list(known.numbers)[: known.shape.words]
    h = known.shape.state

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def outcomes(state):
        """Log probability of every outcome: own words, and the classes of others."""
        outer = p["outer"] @ state + p["outer_bias"][:, 0]
        outer -= np.log(np.exp(outer).sum())
        out = []
        for k in range(known.shape.classes):
            inner = p["inner"][k] @ state + p["inner_bias"][k][:, 0]
            out += list(outer[k] + inner - np.log(np.exp(inner).sum()))
        assert abs(np.exp(out).sum() + np.exp(outer[known.shape.classes :]).sum() - 1) < 1e-4
        return out[: len(own)] + list(outer[known.shape.classes :])

    rare = [[w for w in c if w not in own and crc32(w[-2:]) % known.shape.rare == k] for k in range(known.shape.rare)]

    def alone(text):
        state, before, total = np.zeros(h), 0, 0.0
        for w in lm_score._words(text):
            x, past = p["input"][before], p["again"] @ state
            z, r = sigmoid(x[:h] + past[:h]), sigmoid(x[h : 2 * h] + past[h : 2 * h])
            new = np.tanh(x[2 * h :] + r * (past[2 * h :] + p["reset_bias"][:, 0]))
            state = (1 - z) * new + z * state
            if w in own:
                before = own.index(w)
                total += outcomes(state)[before] / math.log(10)
            else:
                k = crc32(w[-2:]) % known.shape.rare
                before = len(own) + k
                n = sum(c[x] for x in rare[k])
                total += outcomes(state)[before] / math.log(10)
                total += math.log10((c[w] + 0.5) / (n + 0.5 * (len(rare[k]) + 1)))
        return total

    parameters = recurrent.flat(p)
    short = [r for r in rows if len(r[1] or "") < 400]
    found = lm_score.score(documents(short), counts, known, parameters).collect()
    want = sorted((k is None, k or 0, alone(t)) for k, t in short)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in found)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want, strict=True)) < 1e-3


def test_gradients():
    rng = np.random.default_rng(0)
    shape = recurrent.Shape(words=5, rare=2, width=2, state=3)
    p = {k: v.astype(np.float64) for k, v in recurrent.initial(shape, np.arange(1, 8)).items()}
    p["outer"] += rng.normal(0, 0.5, p["outer"].shape)
    p["inner"] += rng.normal(0, 0.5, p["inner"].shape)
    read, wanted = rng.integers(0, 7, (2, 6, 4))
    window = recurrent.Window(np.arange(4), read, wanted, np.array([4, 4, 3, 3, 2, 1]), None, [], [])
    state = rng.normal(0, 1, (3, 4))

    def found():
        space = recurrent.Space(shape, 6, 4, np.float64)
        space.state = state.copy()
        return recurrent.gradients(p, shape, space, window)

    g = {name: x.copy() for name, x in found()[2].items()}
    for name, x in p.items():
        for _ in range(20):
            at = tuple(int(rng.integers(0, n)) for n in x.shape)
            here, sides = x[at], []
            for d in (1e-3, -1e-3):
                x[at] = here + d
                sides.append(found()[1])
            x[at] = here
            assert abs((sides[0] - sides[1]) / 2e-3 - g[name][at]) < 1e-4, name


def test_windows_hold_every_token_once_and_in_order():
    rng = np.random.default_rng(1)
    texts = [np.append(rng.integers(1, 50, n), 0).astype(np.int32) for n in [0, 5, 700, 1, 33, 64, 63, 2, 0]]
    read, ended = {k: [] for k in range(len(texts))}, []
    place = {}
    for w in recurrent.windows(enumerate(texts), 4, 16):
        assert all(a >= b for a, b in pairwise(w.active))
        for t, n in enumerate(w.active):
            for lane in range(n):
                key = w.keys[w.texts[t, lane]]
                at = len(read[key])
                assert w.read[t, lane] == (texts[key][at - 1] if at else 0)
                read[key].append(int(w.wanted[t, lane]))
        ended += w.ended
        place |= dict.fromkeys(w.keys, w)
    assert sorted(ended) == list(range(len(texts)))
    assert all(read[k] == t.tolist() for k, t in enumerate(texts))


def test_scores_do_not_depend_on_lanes():
    rng = np.random.default_rng(2)
    shape = recurrent.Shape(20, 4, width=8)
    p = recurrent.initial(shape, np.ones(24))
    texts = [np.append(rng.integers(1, 24, n), 0).astype(np.int32) for n in rng.integers(0, 300, 40)]
    want = dict(recurrent.score(p, shape, enumerate(texts), 1, 1))
    for many, steps in ((3, 7), (100, 64)):
        found = dict(recurrent.score(p, shape, enumerate(texts), many, steps))
        assert found.keys() == want.keys()
        assert all(abs(found[k] - want[k]) < 1e-3 for k in want)


def test_learns_order():
    """Texts whose next word follows from the last: far better than counts."""
    rng = np.random.default_rng(3)
    shape = recurrent.Shape(13, 1, width=8)
    texts = [np.append((rng.integers(12) + np.arange(60)) % 12 + 1, 0).astype(np.int32) for _ in range(1600)]
    p = recurrent.initial(shape, np.bincount(np.concatenate(texts), minlength=14).astype(float))
    before = sum(x for _, x in recurrent.score(p, shape, enumerate(texts[:100])))
    met, _ = recurrent.train(p, shape, recurrent.Adam(p, 0.02), enumerate(texts[100:]), 32, 16)
    assert met == 61 * 1500
    assert sum(x for _, x in recurrent.score(p, shape, enumerate(texts[:100]))) > 0.5 * before


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm_score.report(docs).where("held_out").collect()
    better = sum(r.score > r.base_score for r in rows)
    assert better > 0.8 * len(rows)
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)


def test_empty(spark, documents):
    assert lm_score.report(documents([])).collect() == []
    rows = lm_score.report(documents([(k, "a b") for k in range(50) if held(k)])).collect()
    assert rows and all(r.train_tokens == 0 == r.n_known and r.base_score == 0 for r in rows)


def test_most_frequent_words_fill_the_room(spark):
    """Words below a share of 1 / heavy are taken too, the most frequent first, while there is room."""
    rows = [(b"w%02d" % i, 100, 100) for i in range(4)] + [(b"x%02d" % i, 2, 2) for i in range(40)]
    rows += [(b"y%03d" % i, 1, 1) for i in range(400)]
    counts = spark.createDataFrame([(lm_score.END, 50, 50), *rows], "word BINARY, c LONG, n LONG")
    known = lm_score.lexicon(counts, 64, 8)
    assert list(known.numbers) == [lm_score.END] + [w for w, c, _ in rows if c > 1]
    assert list(known.numbers) == list(lm_score.lexicon(counts, 45, 8).numbers)
    assert len(lm_score.lexicon(counts, 44, 8).numbers) == 5


def test_words_of_all_texts_are_read_at_once():
    """Texts touch in a column's buffer; their words do not."""
    import pyarrow as pa

    texts = ["The cat", None, "", "x", "É\tab\x1cc", " \n", "Y" * 65 + " y", "b\x00 C\x0bd", "é", "z" * 64]
    want = [[] if t is None else t.encode().lower().split() for t in texts]
    found = lm_score._text(pa.array(texts).slice(1))
    assert np.diff(found.bounds).tolist() == [len(w) for w in want[1:]]
    words = found.words.to_pylist()
    assert [w if len(w) <= 64 else None for t in want[1:] for w in t] == [
        None if w.startswith(lm_score.END) else w for w in words
    ]
    known = [lm_score.END, b"x", b"ab\x1cc", next(w for w in words if w.startswith(lm_score.END))]
    numbers, bounds = lm_score._Reader(pa.array(known, pa.binary()), 8).read(found)
    assert (numbers[bounds[1:] - 1] == 0).all() and len(numbers) == len(words) + len(texts) - 1
    number = lambda w: known.index(w) if w in known else len(known) + crc32(w[-2:]) % 8
    assert numbers[numbers != 0].tolist() == [number(w) for w in words]


def test_scoring_keeps_no_steps_for_backpropagation():
    shape = recurrent.Shape(20, 4, width=8)
    kept, scored = (recurrent.Space(shape, 32, 16, learn=learn) for learn in (True, False))
    assert kept.gates.shape[0] == kept.new.shape[0] == 32 and scored.gates.shape[0] == scored.new.shape[0] == 1
    assert not hasattr(scored, "places")
