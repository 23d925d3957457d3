from __future__ import annotations

import random

import corpus_pipeline
from speclake.llm.graph import components
from speclake.llm.shared import staged


def sentence(rng, n=12):
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n)) + "."


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {k: find(k) for k in root if any(k in p and p[0] != p[1] for p in links)}
    frame = spark.createDataFrame(links, "a LONG, b LONG")
    assert {r.node: r.root for r in components(frame).collect()} == want
    assert components(frame.limit(0)).collect() == []


def test_stages_keep_clean_and_drop_the_rest(spark, tmp_path):
    rng = random.Random(2)
    text = lambda n: "\n".join(sentence(rng) for _ in range(n))
    clean = {k: text(8) for k in range(20)}
    leak = sentence(rng, 30)
    near = clean[3].replace("\n", " ")
    rows = [*clean.items(), (50, clean[2]), (51, near), (52, text(8) + "\n" + leak), (53, "few words."),
            (54, "a | b | c | d\n" * 30), (55, None), (56, text(6) + "\n" + clean[4].split("\n")[0])]
    frame = spark.createDataFrame(
        [(k, t, "en", "s", len(t or "")) for k, t in rows],
        "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG",
    )
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id LONG, text STRING").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination",
        "SentencePiece encoding and decoding",
    ]
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = staged(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
        left.append({r.doc_id: r.text for r in docs.collect()})
    assert set(left[0]) == {*clean, 50, 51, 52, 56}
    assert set(left[1]) == set(left[0]) - {50} and left[1][56].count("\n") == 5
    assert set(left[2]) == set(left[1]) - {51}
    assert set(left[3]) == set(left[2]) - {52}
    assert all(left[3][k] == t for k, t in clean.items())
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(left[3]) and all(r.agrees for r in rows)
