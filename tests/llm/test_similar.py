from __future__ import annotations

import random
import re

import pytest

from speclake.llm import similar


def brute(rows, n=5, percent=75):
    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets[key] = {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, bool(w)))}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def family(rng, voc, n, copies, edits):
    base = [rng.choice(voc) for _ in range(n)]
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(voc)
        yield " ".join(w)


@pytest.mark.parametrize("block", [512, 8])
def test_equals_brute_force(spark, documents, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(block)
    voc = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n\t", "one two", "one two", "a b c d e", "a b c d e f"]
    texts += family(rng, voc, 120, 60, 7)
    texts += family(rng, voc, 60, 40, 4)
    texts += family(rng, voc, 14, 30, 1)
    texts += family(rng, ["x", "y"], 8, 20, 1)
    common = " ".join(rng.choice(voc) for _ in range(60))
    texts += [common + " " + t for t in family(rng, voc, 25, 25, 25)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 10))
    found = similar.classes(documents(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows)


def test_first_of_each_keeps_columns_of_any_names(spark):
    from speclake.llm import similar

    rows = [(1, "a b c d e f", 7, "x", 1, 2, 3), (2, "a b c d e f", 8, "y", 4, 5, 6), (3, None, 9, "z", 7, 8, 9)]
    frame = spark.createDataFrame(
        rows, "doc_id LONG, text STRING, _id INT, _h STRING, id INT, hash INT, `a.b` INT"
    )
    kept = similar.first_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_size_boundary_is_the_cheapest():
    assert similar.boundary([]) == 0
    assert similar.boundary([(3, 1, 10), (4, 2, 10), (5, 50, 10)]) == 5
    assert similar.boundary([(3, 9, 1)]) == 0


def test_null_keys_and_repeated_rows(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (7, text), (7, text), (9, text + " i"), (None, None), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    found = sorted(
        (tuple(r) for r in similar.classes(frame).collect()), key=lambda r: (r[0] is None, r)
    )
    assert found[:4] == [(3, 0, 3), (7, 4, 7), (7, 4, 7), (9, 5, 7)]
    assert sorted(found[4:], key=str) == [(None, 0, None), (None, 4, 7)]
    kept = similar.first_of_each(frame)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(((r.doc_id or 0, r.text or "") for r in kept.collect())) == [
        (0, ""), (3, ""), (7, text), (7, text)
    ]


def test_query_lower_cases_ascii_letters(spark, tmp_path):
    from speclake.llm.queries import QUERIES

    rows = [(1, "The Cat sat ON the mat"), (2, "the cat SAT on The Mat"), (3, "Ä B C D E f"),
            (4, "ä b c d e f"), (5, "A a a A a A a"), (6, "ABC \x0bDEF"), (7, "abc def")]
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(tuple(r) for r in QUERIES["op2_similar"](spark, str(tmp_path)).collect())
    assert found == [(1, 2, 1), (2, 2, 1), (3, 2, 3), (4, 2, 4), (5, 1, 5), (6, 1, 6), (7, 1, 6)]
    assert similar.classes(frame).where("doc_id = 2").first().component_id == 2


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert similar.classes(frame).collect() == []


def test_blocks_give_sets_and_joining_links():
    """Not every pair: of k sets that are all near each other, k rows and k - 1 links."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63 - 1, 200)
    sets = [np.sort(np.concatenate((base, rng.integers(-(2**63), 2**63 - 1, 8)))) for _ in range(90)]
    bits = np.array([similar.sketch(x) for x in sets])
    names, roots, sizes = np.arange(90), np.arange(90), np.full(90, 208)
    near, own = similar._near([(names, roots, sizes, bits)], [(names, roots, sizes, bits)], 75)
    assert sorted(near.tolist()) == list(range(90)) and (near == own).all()
    rows = [{"set": i, "root": i, "shingles": x.tolist()} for i, x in enumerate(sets)]
    kind = pa.struct([("set", pa.int64()), ("root", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    first, second = similar._joining(pa.array(rows, kind), 75)
    assert len(first) == len(second) == 89 and {*first, *second} == set(range(90))
    assert similar._joining(pa.array(rows, kind), 93) == ([], [])


def test_sketches_rule_out_no_linked_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 3, 7, 40, 400, 3000):
        x = rng.integers(-(2**63), 2**63 - 1, n)
        for edits in {0, n // 20, n // 8, n // 7}:
            y = np.concatenate((x[edits:], rng.integers(-(2**63), 2**63 - 1, edits // 2)))
            common = len(np.intersect1d(x, y))
            if 100 * common < 75 * (len(x) + len(y) - common):
                continue
            a, b = similar.sketch(x)[None, :], similar.sketch(y)[None, :]
            words = min(a.shape[1], b.shape[1])
            differing = np.bitwise_count(similar.folded(a, words) ^ similar.folded(b, words)).sum()
            assert similar.may_link(int(differing), len(x), len(y), 75)


def test_a_common_shingle_has_two_rows_of_a_task(spark, documents, monkeypatch):
    """What a task knows to be shared is counted there; the same sets survive."""
    rng = random.Random(6)
    voc = [f"w{i}" for i in range(500)]
    lines = [" ".join(rng.choices(voc, k=8)) for _ in range(3)]
    texts = [" ".join([*rng.choices(lines, k=2), *rng.choices(voc, k=rng.randint(0, 12))]) for _ in range(150)]
    texts += [None, "", *texts[:20]]
    docs = documents(list(enumerate(texts))).selectExpr("doc_id AS id", "xxhash64(text) AS h", "coalesce(text, '') AS t")
    found = {}
    for lot in (1 << 20, 1):
        monkeypatch.setattr(similar, "LOT", lot)
        base = similar.staged(similar._base(docs.coalesce(1), 5, 75, False))
        rows = base.where("keys IS NOT NULL").selectExpr("explode(keys) AS key").groupBy("key").count()
        assert lot == 1 or rows.agg({"count": "max"}).first()[0] == 2
        assert base.count() == len(texts)
        found[lot] = {tuple(r) for r in similar._survivors(base, 75).collect()}
    firsts = {}
    for t in texts:
        hashes, _ = similar.shingle_sets(similar.W.words_of(similar.pa.array([t or ""]), similar.W.SPACED, False), 5)
        n = len(hashes)
        firsts[tuple(hashes.tolist())] = set(hashes[: n - similar.least_common(n) + 1 + n // similar.SPARE].tolist())
    want = 0
    for whole, own in firsts.items():
        met = sum(any(k in other for s, other in firsts.items() if s != whole) for k in own)
        want += bool(whole) and met >= similar.least_common(len(whole)) // similar.SPARE + 1
    assert found[1] == found[1 << 20] and 0 < len(found[1]) == want < len(firsts)
