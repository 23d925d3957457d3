from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

from speclake.llm import filter_audit

DOCS = "text STRING, doc_id LONG, source STRING, part STRING, mask INT, n STRING, digest INT"
LABELS = "doc_id LONG, quality INT, toxic INT, good INT"


def fails(rows):
    """The filters each row fails, straight from their definition."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None
            and any(k is not None and k < doc_id and (t or "") == text for k, t, _ in rows),
        }
        out.append({f for f, x in bad.items() if x})
    return out


def brute_force(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    bad = fails(rows)
    found = {}
    for part in {s or "" for _, _, s in rows}:
        mine = [(k, f) for (k, _, s), f in zip(rows, bad, strict=True) if (s or "") == part]
        shares = Counter()
        for order in permutations("ABCDE"):
            left, gone = list(mine), []
            for step, f in enumerate(order, 1):
                out = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shares[f] += len(out)
                found[part, "".join(order), step] = [
                    len(left),
                    len(out),
                    sum(f in x[1] for x in gone),
                    sum(x[1] == {f} for x in mine),
                    sum(x[0] in good for x in out),
                    sum(x[0] in toxic for x in out),
                ]
                gone += out
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                found[part, "".join(order), step].append(shares[f])
    return {k: tuple(v) for k, v in found.items()}


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(t, k, s, "x", -1, "y", 3) for k, t, s in rows], DOCS)
    return docs, spark.createDataFrame([(*row, 9) for row in labels], LABELS)


def table_of(report):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in report.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(90)]
    rows = [(1, None, None), (2, "", ""), (3, None, "a"), (None, "", "a"), (None, "x y", "b")]
    rows += [(4, "A B C", "a"), (4, "A B C", "a"), (4, "A B C", "b"), (5, "A B C", "a"), (0, "é Ü ß", "a")]
    for k in range(10, 170):
        text = " ".join(rng.choices(words[: rng.choice([20, 90])], k=rng.choice([3, 49, 50, 60])))
        text += rng.choice(["", "", " #", "\t|\n", " " + "X" * 30])
        rows.append((k, text, rng.choice(["a", "a", "b", None])))
    rows += [(200 + k, rows[20 + 2 * k][1], rng.choice(["a", "b"])) for k in range(60)]
    rows.append((900, "word " * 40_000, "b"))
    rng.shuffle(rows)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 250, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)]
    assert len({frozenset(f) for f in fails(rows)}) > 15
    found = filter_audit.report(*frames(spark, rows, labels))
    assert table_of(found) == brute_force(rows, labels)
    assert found.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley",
    ]


def test_empty_tables(spark):
    assert filter_audit.report(*frames(spark, [], [(1, 1, 1)])).collect() == []
    rows = [(1, "a b", None)]
    assert table_of(filter_audit.report(*frames(spark, rows, []))) == brute_force(rows, [])


def test_intervals_hold_just_the_orders_of_a_removal():
    for n in (1, 2, 4, 5):
        orders = list(permutations(range(n)))
        held = Counter()
        for mask, step, start, end in filter_audit.removal_intervals(n):
            held.update((mask, step, rank) for rank in range(start, end))
        assert held == Counter(
            (mask, min(i for i, f in enumerate(order) if mask >> f & 1), rank)
            for rank, order in enumerate(orders)
            for mask in range(1, 1 << n)
        )


def test_other_filters(spark):
    """The audit itself takes any masks: three filters, six orders."""
    counts = spark.createDataFrame(
        [("p", 0b011, False, True, 5), ("p", 0b100, True, False, 2), ("p", 0, True, True, 1)],
        "part STRING, mask INT, good BOOLEAN, toxic BOOLEAN, n LONG",
    )
    rows = {(r.filter_order, r.step): r for r in filter_audit.audit(counts, "xyz").collect()}
    assert len(rows) == 18
    first = rows["xyz", 1]
    assert (first.kept, first.removed, first.toxic_lost, first.good_lost) == (3, 5, 5, 0)
    assert rows["xyz", 2].redundant == 5 and rows["xyz", 3].kept == 1
    assert (rows["zyx", 2].shapley, rows["zyx", 1].shapley, rows["zyx", 3].shapley) == (15, 12, 15)
