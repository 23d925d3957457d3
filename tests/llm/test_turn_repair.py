from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from speclake.llm import turn_repair

ROWS = "conv_id LONG, turn LONG, role STRING, text STRING, digest INT, letters STRING, audit STRING"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda r: (
        r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    )
    return sorted(out, key=order)


def cheapest(rows, faults):
    """(audit, cost, repaired) by a search over all edits, cheapest and ASCII-least first."""
    heap, met = [(0, "", 0, "", ())], {}
    while True:
        cost, audit, i, roles, kept = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return audit, cost, kept
        state = (i, len(roles) > 0, roles[-1:])
        if met.setdefault(state, (cost, audit)) != (cost, audit) and met[state][0] < cost:
            continue

        def go(more, letter, nxt, turn, cost=cost, audit=audit, roles=roles, kept=kept):
            new = roles + (turn[0][:1] or "-") if turn else roles
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, audit + letter, nxt, new, kept + ((turn,) if turn else ())))

        for role in ("user", "assistant"):
            go(3, "I", i, (role, ""))
        if i < len(rows):
            _, role, text = rows[i]
            go(4, "D", i + 1, None)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                go(more, "K", i + 1, (role, text))
                for other in ("user", "assistant"):
                    go(3 + more, "R", i + 1, (other, text))


def brute_force(table):
    found = {}
    for conv in {r[0] for r in table}:
        rows = damaged([r for r in table if r[0] == conv])
        seen, faults = set(), []
        for _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else ""
            faults.append(fault or ("" if last[0] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
        audit, cost, kept = cheapest(rows, faults)
        text = "\n".join(f"{role}:{text}" for role, text in kept)
        found[conv] = (
            gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return found


def some_rows():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "So?", "cut off", "", " \t", "Ünï. ", None, "A\nb.\n"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(rng.choice([0, 1, 2, 5, 9]) + (conv is None)):
            turn = rng.choice([turn, turn, turn, None, 3 * turn])
            rows.append((conv, turn, rng.choice(roles), rng.choice([f"t{rng.random()}.", *texts])))
    for turn in range(6):  # a usual one
        rows.append((500, turn, ["user", "assistant"][turn % 2], f"Text {turn}."))
    rows += rows[:40]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "l", None) for r in rows], ROWS)


def as_table(report):
    return {r.conv_id: tuple(r[n] for n in NAMES) for r in report.collect()}


def test_equals_brute_force(spark):
    rows = some_rows()
    assert as_table(turn_repair.report(frame(spark, rows))) == brute_force(rows)


@pytest.mark.parametrize("ranges", [1, 40])
def test_long_conversations_are_cut_into_segments(spark, ranges):
    rng = random.Random(3)
    rows = [
        (conv, turn, rng.choice(["user", "assistant", "tool"]), rng.choice([f"Turn {turn}.", "Again.", "cut"]))
        for conv, n in ((1, 90), (2, 3), (3, 40), (None, 30))
        for turn in range(n)
    ]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = frame(spark, rows)
        found = turn_repair.segments(turn_repair.damage(table).where("NOT gone"))
        most = found.groupBy("conv_id").count().agg(F.max("count")).first()[0]
        assert most > 8 if ranges > 1 else most == 1
        assert as_table(turn_repair.report(table)) == brute_force(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_rows(spark):
    rows = frame(spark, [(1, 1, "assistant", "B."), (1, 2, "tool", "C."), (1, 3, "x", ""), (2, 0, "x", "")])
    found = turn_repair.plans(turn_repair.segments(rows))
    kept = turn_repair.repaired(rows, found).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in kept] == [
        (1, 0, "user", ""), (1, 1, "assistant", "B."), (1, 2, "user", "C."), (1, 3, "assistant", ""),
    ] or [tuple(r)[2:] for r in kept] == [("user", "B."), ("assistant", "C.")]


def test_blocks_of_any_length_agree():
    rng = random.Random(4)
    tables = [turn_repair.Tables(b) for b in (1, 2, 3)]
    for _ in range(300):
        codes = [rng.choice(range(16)) for _ in range(rng.randint(0, 20))]
        want = turn_repair.repair(codes)
        for known in tables:
            blocks, rest = (x.tolist() for x in known.blocks(turn_repair.np.array(codes, int)))
            vectors, cost = known.backward(blocks, rest, 0)
            audit, state = known.forward(blocks, rest, vectors, 0, turn_repair.START)
            assert audit + turn_repair._TAIL[state] == want[0]
            assert cost + known.vectors[vectors[0]][turn_repair.START] == want[1]


def test_a_long_conversation_takes_no_time_per_row():
    audit, cost = turn_repair.repair([1, 2] * 100_000 + [13])
    assert (audit, cost) == ("K" * 200_000 + "D", 4)


def test_empty_table(spark):
    assert turn_repair.report(frame(spark, [])).collect() == []


def test_no_row_left(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    found = as_table(turn_repair.report(frame(spark, [(conv, 0, "user", "A.")])))
    assert found == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
