from __future__ import annotations

import random

from speclake.llm import line_dedup as L


def longest_rising(values):
    best = []
    for n, v in enumerate(values):
        best.append(1 + max((best[m] for m in range(n) if values[m] < v), default=0))
    return max(best, default=0)


def test_patience_is_an_alignment():
    rng = random.Random(0)
    for _ in range(500):
        x = [rng.randrange(9) for _ in range(rng.randint(0, 12))]
        y = [rng.randrange(9) for _ in range(rng.randint(0, 12))]
        found = L.patience(x, y)
        assert all(x[i] == y[j] for i, j in found)
        assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:], strict=False))
    for _ in range(200):  # lines that are all unique: the longest common order
        x, y = rng.sample(range(20), 12), rng.sample(range(20), 12)
        found = L.patience(x, y)
        assert len(found) == longest_rising([y.index(v) for v in x if v in y])
    assert L.patience([1, 2, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (3, 2)]


def aligned_pairs(rows, least):
    """What the alignment of every pair of documents deletes."""
    split = {k: [x.strip(" \t\n\v\f\r") for x in (t or "").split("\n")] for k, t in rows}
    gone = {k: set() for k in split}
    for a in split:
        for b in split:
            if a < b:
                x = [v for v in split[a] if v]
                places = [i for i, v in enumerate(split[b]) if v]
                y = [split[b][i] for i in places]
                found = L.common_lines(x, y, [len(v.split()) for v in y], least)
                gone[b] |= {places[j] for j in found}
    return gone


def case(rng):
    line = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    shared = [line(rng.randint(2, 9)) for _ in range(14)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [line(rng.randint(1, 9)) for _ in range(rng.randint(0, 2))]
            at = rng.randrange(len(shared))
            text += shared[at : at + rng.randint(1, 4)] + rng.choice([[], ["", "  "]])
        rows.append((k, "\n".join(text)))
    return [*rows, (100, None), (101, ""), (102, rows[5][1]), (103, rows[5][1])]


def test_deduped_keeps_columns(documents):
    block = "one two three four five six seven\neight nine ten eleven twelve thirteen"
    rows = [(1, "own\n" + block), (2, block + "\nmine"), (3, block), (4, None), (5, "own"), (2, "x")]
    frame = documents(rows)
    out = L.deduped(frame)
    assert out.columns == frame.columns
    found = sorted((r.doc_id, r.text or "", r.n_chars, r.h) for r in out.collect())
    assert found == [
        (1, "own\n" + block, -1, "1"), (2, "mine", 4, "2"), (2, "x", -1, "2"), (4, "", -1, "4"),
        (5, "own", -1, "5"),
    ]
    assert L.deduped(documents([])).collect() == []


def test_null_keys_are_left_alone(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    frame = spark.createDataFrame([(None, text), (1, text), (None, text)], "doc_id LONG, text STRING")
    assert L.deduped(frame).count() == 3


def all_blocks(rows, least):
    """Every run of ``least`` words or more: its documents with the places of its lines."""
    found = {}
    for k, t in rows:
        split = [(i, x.strip(" \t\n\v\f\r")) for i, x in enumerate((t or "").split("\n"))]
        split = [(i, x) for i, x in split if x]
        for a in range(len(split)):
            for b in range(a, len(split)):
                if sum(len(x.split()) for _, x in split[a : b + 1]) >= least:
                    places = found.setdefault(tuple(x for _, x in split[a : b + 1]), {})
                    places.setdefault(k, set()).update(i for i, _ in split[a : b + 1])
    return found


def held_before(rows, least):
    """Lines in a run of ``least`` words or more that an earlier document holds too."""
    gone = {k: set() for k, _ in rows}
    for held in all_blocks(rows, least).values():
        for k in held.keys() - {min(held)}:
            gone[k] |= held[k]
    return gone


def deleted(documents, rows):
    return {r.doc_id: set(r.deleted) for r in L.report(documents(rows)).collect()}


def test_equals_brute_force(documents):
    for seed in (1, 2, 3):
        rows = case(random.Random(seed))
        found = deleted(documents, rows)
        assert found == held_before(rows, L.LEAST_WORDS)
        pairs = aligned_pairs(rows, L.LEAST_WORDS)
        assert all(pairs[k] <= found[k] for k in pairs)


def test_the_number_of_holders_changes_nothing(documents):
    """Blocks that moved, or are repeated, go whether two documents hold them or fifty."""
    one = "one two three four five six seven eight nine ten eleven twelve"
    two = "a line of seven short words here\nand another line of seven words more"
    first = f"{one}\nown\n{two}\nlast"
    moved = f"top @\n{two}\nbetween @\n{one}\n{one}\nend @"
    for copies in (1, 50):
        rows = [(0, first), *((k, moved.replace("@", str(k))) for k in range(1, 1 + copies))]
        found = deleted(documents, rows)
        assert found == {0: set(), **{k: {1, 2, 4, 5} for k in range(1, 1 + copies)}}


def test_marks_of_many_lines_are_read_by_place(documents):
    lines = [f"line {i} of a long text with more than twelve words in every line" for i in range(20000)]
    text = "\n".join(lines)
    found = deleted(documents, [(1, text), (2, "own\n" + text), (3, "x")])
    assert found == {1: set(), 2: set(range(1, 20001)), 3: set()}
    out = {r.doc_id: r.text for r in L.deduped(documents([(1, text), (2, "own\n" + text)])).collect()}
    assert out == {1: text, 2: "own"}


def test_frequent_blocks(documents):
    long = "one two three four five six seven eight nine ten eleven twelve"
    twice = [(0, f"{long}\nown\n{long}\nend of the first"), *((k, f"b{k}\n{long}\ne{k}") for k in range(1, 12))]
    found = {r.doc_id: r.deleted for r in L.report(documents(twice)).collect()}
    assert found == {0: [], **{k: [1] for k in range(1, 12)}}
    short = [f"{x} line of five words" for x in "abc"]
    # Each line has another first holder, so no document shares the block with any of them.
    apart = [(k, f"{x}\nmore of {k}") for k, x in enumerate(short)]
    block = [(k, f"top {k}\n" + "\n".join(short) + f"\nend {k}") for k in range(3, 15)]
    found = {r.doc_id: r.deleted for r in L.report(documents(apart + block)).collect()}
    assert found == {**{k: [] for k in range(4)}, **{k: [1, 2, 3] for k in range(4, 15)}}
