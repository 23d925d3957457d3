"""Changes of listings on a stream: as on all fragments at once, whatever the batches."""

from __future__ import annotations

import random

import pytest

from speclake.streaming import changes

SHAPE = "page STRING, frag_no LONG, state STRING"


@pytest.fixture
def deliver(spark, tmp_path):
    place = f"file://{tmp_path}"

    def run(number, rows):
        changes.change_batch(spark.createDataFrame(rows, SHAPE), number, place, ["page"], "frag_no", "state")

    def told():
        return {(r.page, r.frag_no): (r.changed, r.late) for r in changes.told_changes(spark, place).collect()}

    def settled():
        rows = changes.settled_changes(spark, place, ["page"], "frag_no", "state").collect()
        return {(r.page, r.frag_no): r.changed for r in rows}

    return run, told, settled


def expected(batches):
    ends, told, everything = {}, {}, {}
    for rows in batches:
        before = dict(ends)
        rows = [r for r in rows if r[0] is not None]
        for page, at, state in sorted(rows, key=str):
            everything.setdefault(page, {})[at] = state
        for page, at, state in sorted(rows, key=lambda r: (str(r[0]), r[1])):
            if page in before and at <= before[page][0]:
                told[page, at] = (None, True)
            else:
                told[page, at] = (ends[page][1] != state if page in ends else None, False)
                ends[page] = (at, state)
    settled = {}
    for page, states in everything.items():
        last = None
        for at in sorted(states):
            settled[page, at] = None if last is None else states[last] != states[at]
            last = at
    return told, settled


def test_batches_and_late_fragments(deliver, monkeypatch):
    monkeypatch.setattr(changes, "WHOLE", 2)  # whole states and parts take turns
    run, told, settled = deliver
    rng = random.Random(0)
    rows = [(p, n * 40_000, rng.choice(["a", "b", None])) for p in ("x", "y", None) for n in range(12)]
    rows.append(("once", 1, "a"))
    batches = [[] for _ in range(4)]
    for row in rows:
        late = rng.random() < 0.25
        batches[3 if late else min(2, row[1] // 160_000)].append(row)
    for number, batch in enumerate(batches):
        run(number, batch)
        if number == 2:
            run(number, batch)  # delivered again
    assert (told(), settled()) == expected(batches)


def test_repeated_rows_and_no_rows(deliver):
    run, told, _ = deliver
    run(0, [("x", 1, "b"), ("x", 1, "a"), ("x", 1, "b"), ("x", None, "c"), ("x", 2, "a")])
    run(1, [])
    run(2, [("x", 3, "b"), ("x", 2, "z")])
    # A number that comes again in a later batch is late there.
    assert told()["x", 1] == (None, False) and told()["x", 3] == (True, False)
    assert len(told()) == 3
