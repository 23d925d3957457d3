from __future__ import annotations

import random
import re

from speclake.llm import decontaminate


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, width=10):
    out = {}
    for key, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, item in items:
            v = words(item)
            n = min(width, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    names.add(str(name))
        out[key] = (len(w), len(hit), sorted(names))
    return out


def case(rng):
    voc = ["a", "b", "É", "x1", "Zz", "ünder"]
    line = lambda n: " ".join(rng.choice(voc) for _ in range(n))
    items = [(i, line(rng.randint(8, 25))) for i in range(12)]
    items += [(50, None), (51, "  "), (52, items[0][1]), (53, "b É, x1-Zz")]
    docs = [(i, line(rng.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, line(9) + "; " + rng.choice(items[:12])[1].upper()[:40]) for i in range(30)]
    docs += [(200, None), (201, ""), (202, "b\nÉ\tX1 ZZ"), (203, "long " * 50_000 + items[1][1])]
    return docs, items


def test_equals_brute_force(spark, documents):
    docs, items = case(random.Random(3))
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    want = brute(docs, items)
    for block in (decontaminate.BLOCK, 30):  # one block, and many
        rows = decontaminate.contamination(documents(docs), bench, block=block).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == want


def test_remove_keeps_columns(spark, documents):
    docs, items = case(random.Random(4))
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    frame, want = documents(docs), brute(docs, items)
    kept = decontaminate.remove(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if not v[1]}
    cut = {r.doc_id: r.text for r in decontaminate.remove(frame, bench, what="spans").collect()}
    assert set(cut) == set(want)
    for key, text in docs:
        if want[key][1]:
            assert len(words(cut[key])) == want[key][0] - want[key][1]
        else:
            assert cut[key] == text


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id LONG, text STRING")
    rows = decontaminate.contamination(documents([(1, "a b")]), none).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == [(2, 0, [])]
    assert decontaminate.contamination(documents([]), none).collect() == []
