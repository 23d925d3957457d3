"""Repair of the turn structure of conversations, at least cost.

The edits of a conversation are paths through an automaton of four states:
nothing yet, a system turn, a user's turn, an assistant's turn.  What it costs
from each state to the end is a vector of four numbers.  Less its least entry,
only some dozen vectors occur at all, so the vectors before a *block* of
``BLOCK`` rows are tabulated for every vector behind it and every block of row
symbols (Four Russians), and a conversation's vectors are looked up block by
block from its end.  With the costs to the end known, edits are then read off
forwards: every block is expanded backwards into the vectors between its rows,
and at each point the ASCII-least letter is taken among the edits that keep the
least cost.  From a state only one of user and assistant can follow, so a letter
decides the next state, and the greedy string is the least of all cheapest.

On Spark a conversation may be longer than a task should hold.  Rows (keys,
digests and symbols only) are dealt by ranges of (conversation, turn), so a long
one becomes several segments.  For those, a segment's effect on the vectors is
a min-plus matrix; matrices of one conversation, at most one per range, are
combined into each segment's end vector.  A segment is then traced from all
four states, and the states are followed over the segments.  A row counts as
repeated if its digest was met earlier: the earliest turn per digest combines
before the shuffle and is joined by the row's own key, so neither a long
conversation nor a very frequent text meets in one task.  Only the text of the
repaired rows is read in order by one task per conversation, as a stream: a
SHA-256 over it can't be worked out in parts.

Nulls: a NULL turn, role or text is one space (the turn: in the checksum; it
sorts first and counts for no gap); NULL conv_ids are one conversation.  Rows of
the same turn follow in the order of the digest of role and text; equal rows are
copies, all but the first of them duplicates.  A conversation without rows left
has zeros and the hash of an empty text.  An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speclake.llm.shared import arrow_schema, in_arrow, staged

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs
BLOCK = 4  # rows of a block

NOT_SPACE = r"[^\x20\x09-\x0D]"
_LAST = rf"({NOT_SPACE})[\x20\x09-\x0D]*\z"

# A row's code is its role's initial and its first fault.
INITIALS = "sua"  # 3: any other
FINE, CUT, BLANK, AGAIN = 0, 4, 8, 12

START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)  # by an edit that may choose the role
_ROLE = ("", "system", "user", "assistant")
_KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
_TAIL = ("", "II", "I", "")
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_FAR = 1 << 40  # no way

_SYMBOLS = 9  # initial and cut, or 8: must go


def symbol(code: int) -> int:
    return code if code < BLANK else 8


def edits(sym: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of every edit of one row, in ASCII order."""
    yield "D", DELETE, state
    if sym < 8:
        more = TRUNCATED if sym >= CUT else 0
        kept = _KEEP.get((state, sym % 4))
        if kept is not None:
            yield "K", more, kept
        yield "R", REROLE + more, _NEXT[state]


def _closed(vector: list[int]) -> list[int]:
    """Costs to the end if turns may be inserted first."""
    user = min(vector[USER], INSERT + vector[ASSISTANT])
    assistant = min(vector[ASSISTANT], INSERT + vector[USER])
    first = [min(vector[s], INSERT + user) for s in (START, SYSTEM)]
    return [min(x, _FAR) for x in (*first, user, assistant)]


def _before(vector: tuple[int, ...], sym: int) -> list[int]:
    """Costs to the end before a row, from those after it."""
    return _closed(
        [min(cost + vector[to] for _, cost, to in edits(sym, state)) for state in range(4)]
    )


def _normal(vector: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(vector)
    return tuple(x - least if x < _FAR else _FAR for x in vector), least


class Tables:
    """All normalised vectors, what a row and what a block does to them."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        ends = [_closed([0, _FAR, _FAR, 0])]  # the end of a conversation: nothing, or an assistant
        ends += [_closed([0 if s == t else _FAR for t in range(4)]) for s in range(4)]
        self.vectors = [_normal(v)[0] for v in ends]
        self.number = {v: i for i, v in enumerate(self.vectors)}
        to, off = [], []
        at = 0
        while at < len(self.vectors):
            found = [_normal(_before(self.vectors[at], sym)) for sym in range(_SYMBOLS)]
            for vector, _ in found:
                if vector not in self.number:
                    self.number[vector] = len(self.vectors)
                    self.vectors.append(vector)
            to.append([self.number[v] for v, _ in found])
            off.append([cost for _, cost in found])
            at += 1
        self.to, self.off = np.array(to, np.int32), np.array(off, np.int64)
        many = len(self.vectors)
        self.block_to = np.arange(many, dtype=np.int32)[:, None]
        self.block_off = np.zeros((many, 1), np.int64)
        for _ in range(block):  # one more row in front of the block
            last = self.block_to
            self.block_off = (self.block_off[:, None, :] + np.swapaxes(self.off[last], 1, 2)).reshape(many, -1)
            self.block_to = np.swapaxes(self.to[last], 1, 2).reshape(many, -1)
        self.expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    def blocks(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block numbers of the whole blocks, and the symbols of the rows behind them."""
        symbols = np.minimum(codes, 8).astype(np.int64)
        whole = len(symbols) // self.block
        places = _SYMBOLS ** np.arange(self.block - 1, -1, -1)
        return symbols[: whole * self.block].reshape(whole, self.block) @ places, symbols[whole * self.block :]

    def backward(self, blocks: list[int], rest: list[int], vector: int) -> tuple[list[int], int]:
        """The vectors behind each block and before the first one, and the cost taken off."""
        cost = 0
        for sym in reversed(rest):
            cost += int(self.off[vector, sym])
            vector = int(self.to[vector, sym])
        found = [vector]
        for number in reversed(blocks):
            cost += int(self.block_off[vector, number])
            vector = int(self.block_to[vector, number])
            found.append(vector)
        found.reverse()
        return found, cost

    def expand(self, symbols: tuple[int, ...], vector: int, state: int) -> tuple[str, int]:
        """Least letters through some rows with ``vector`` behind them, and the state behind."""
        inner = [self.vectors[vector]]
        for sym in reversed(symbols):
            inner.append(_before(inner[-1], sym))
        inner.reverse()
        letters = []
        for i, sym in enumerate(symbols):
            here, after = inner[i], inner[i + 1]
            while True:
                ways = {letter: (cost + after[to], to) for letter, cost, to in edits(sym, state)}
                ways["I"] = (INSERT + here[_NEXT[state]], _NEXT[state])
                letter = min(x for x, (cost, _) in ways.items() if cost == here[state])
                letters.append(letter)
                state = ways[letter][1]
                if letter != "I":
                    break
        return "".join(letters), state

    def forward(self, blocks: list[int], rest: list[int], vectors: list[int], end: int, state: int) -> tuple[str, int]:
        """Letters and last state of a segment: ``vectors`` as ``backward`` gives them."""
        letters = []
        for number, behind in zip(blocks, vectors[1:], strict=True):
            key = (behind, number, state)
            known = self.expanded.get(key)
            if known is None:
                symbols = tuple(number // _SYMBOLS**i % _SYMBOLS for i in range(self.block - 1, -1, -1))
                known = self.expanded[key] = self.expand(symbols, behind, state)
            letters.append(known[0])
            state = known[1]
        more, state = self.expand(tuple(rest), end, state)
        return "".join([*letters, more]), state


@lru_cache
def tables() -> Tables:
    return Tables()


def repair(codes: list[int]) -> tuple[str, int]:
    """(audit, cost) of a whole conversation given by its rows' codes."""
    known = tables()
    blocks, rest = (x.tolist() for x in known.blocks(np.array(codes, np.int64)))
    vectors, cost = known.backward(blocks, rest, 0)
    audit, state = known.forward(blocks, rest, vectors, 0, START)
    return audit + _TAIL[state], cost + known.vectors[vectors[0]][START]


# --- Rows and their codes ---


def _space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults; ``gone`` marks dropped rows.

    The fault is told by crc32(``conv_id:turn``) % 20.
    """
    kind = F.crc32(F.concat(_space("conv_id"), F.lit(":"), _space("turn")).cast("binary")) % 20
    text = _space("text")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(_space("role")).alias("role"),
        F.when(kind == 1, "")
        .when(kind == 2, F.translate(text, ".!?", ""))
        .otherwise(text)
        .alias("text"),
        (kind == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_"),
    ).drop("_")


def _digest() -> Column:
    """Tells (role, text) from all others."""
    return F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))


def _code() -> Column:
    initial = F.substring("role", 1, 1)
    number = F.lit(3)
    for i, letter in enumerate(INITIALS):
        number = F.when(initial == letter, i).otherwise(number)
    last = F.regexp_extract("text", _LAST, 1)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(CUT)
    return (number + fault).cast("tinyint")


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join in which NULL keys are equal."""
    other = right.withColumnsRenamed({c: f"{c}_" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return left.join(other, same, how).drop(*[f"{c}_" for c in on])


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, part, turn, digest, codes): runs of rows of one conversation, one range each.

    ``turn`` and ``digest`` are those of the first row.
    """
    keys = staged(
        rows.select("conv_id", "turn", _digest().alias("digest"), _code().alias("code"))
        .groupBy("conv_id", "turn", "digest", "code")
        .agg(F.count("*").alias("n"))
    )
    firsts = (
        keys.groupBy("conv_id", "digest")
        .agg(F.min(F.struct("turn")).alias("first"))
        .select("conv_id", "digest", F.col("first.turn").alias("turn"), F.lit(True).alias("first"))
    )
    again = (F.col("code") % 4 + AGAIN).cast("tinyint")
    codes = F.when(F.col("code") >= BLANK, F.array_repeat("code", F.col("n").cast("int"))).otherwise(
        F.concat(
            F.when(F.col("first").isNull(), F.array(again)).otherwise(F.array("code")),
            F.array_repeat(again, F.col("n").cast("int") - 1),
        )
    )
    known = _joined(keys, firsts, ["conv_id", "turn", "digest"]).select(
        "conv_id", "turn", "digest", codes.alias("codes")
    )
    found = (
        known.repartitionByRange("conv_id", "turn", "digest")
        .withColumn("part", F.spark_partition_id())
        .groupBy("conv_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "codes"))).alias("rows"))
    )
    return staged(
        found.select(
            "conv_id",
            "part",
            F.col("rows")[0]["turn"].alias("turn"),
            F.col("rows")[0]["digest"].alias("digest"),
            F.flatten("rows.codes").alias("codes"),
        )
    )


# --- Segments of long conversations ---

_TRACE = (
    "part INT, turn {turn}, digest BINARY, blank LONG, duplicate LONG, truncated LONG, "
    "illegal LONG, first INT, last INT, audits ARRAY<STRING>, states ARRAY<INT>, costs ARRAY<LONG>"
)


def _end_vectors(long: DataFrame, conv: T.DataType) -> DataFrame:
    """(conv_id, part, end): the number of the vector behind each segment."""
    matrices = T.StructType(
        [T.StructField("conv_id", conv)] + T._parse_datatype_string("part INT, costs ARRAY<LONG>").fields
    )

    def matrix(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Cost from every state before the segment to every state behind it."""
        known, found = tables(), []
        for codes in batch.column("codes"):
            blocks, rest = (x.tolist() for x in known.blocks(codes.values.to_numpy()))
            columns = []
            for state in range(4):
                vectors, cost = known.backward(blocks, rest, 1 + state)
                columns.append([min(x + cost, _FAR) for x in known.vectors[vectors[0]]])
            found.append([x for column in columns for x in column])
        yield pa.record_batch(
            [batch.column("conv_id"), batch.column("part"), pa.array(found, pa.list_(pa.int64()))],
            schema=arrow_schema(matrices),
        )

    ends = T.StructType([T.StructField("conv_id", conv)] + T._parse_datatype_string("part INT, end INT").fields)

    def follow(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, found = tables(), []
        for conv_id, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            vector = 0
            for part in reversed(parts):
                found.append((conv_id, part["part"], vector))
                behind = known.vectors[vector]
                before = [
                    min(min(part["costs"][4 * to + state] + behind[to], _FAR) for to in range(4))
                    for state in range(4)
                ]
                vector = known.number[_normal(before)[0]]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        schema = arrow_schema(ends)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    each = in_arrow(long.select("conv_id", "part", "codes"), matrix, matrices)
    # At most one matrix per range of the deal, whatever the conversation's length.
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "costs"))).alias("parts"))
    return in_arrow(whole, follow, ends)


def traced(found: DataFrame) -> DataFrame:
    """Every segment with its letters, last state and cost for each of the four first states."""
    conv, turn = found.schema["conv_id"].dataType, found.schema["turn"].dataType
    several = found.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1")
    long = _joined(found, several, ["conv_id"], "left_semi")
    short = _joined(found, several, ["conv_id"], "left_anti")
    ends = _end_vectors(long, conv)
    rows = short.withColumn("end", F.lit(0)).unionByName(
        _joined(long, ends, ["conv_id", "part"], "inner")
    )
    schema = T.StructType(
        [T.StructField("conv_id", conv)]
        + T._parse_datatype_string(_TRACE.format(turn=turn.simpleString())).fields
    )

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known, out = tables(), []
        for codes, end in zip(batch.column("codes"), batch.column("end").to_pylist(), strict=True):
            codes = codes.values.to_numpy().astype(np.int64)
            initials, faults = codes % 4, codes - codes % 4
            pairs = initials[:-1] * 4 + initials[1:]
            legal = np.isin(pairs, [4 * a + b for a, b in _LEGAL])
            blocks, rest = (x.tolist() for x in known.blocks(codes))
            vectors, cost = known.backward(blocks, rest, end)
            ways = [known.forward(blocks, rest, vectors, end, s) for s in range(4)]
            out.append(
                (
                    *(int((faults == kind).sum()) for kind in (BLANK, AGAIN, CUT)),
                    int((~legal).sum()),
                    int(initials[0]),
                    int(initials[-1]),
                    [letters for letters, _ in ways],
                    [state for _, state in ways],
                    # What the segment itself costs: without what follows from its last state.
                    [
                        cost + known.vectors[vectors[0]][s] - known.vectors[end][state]
                        for s, (_, state) in enumerate(ways)
                    ],
                )
            )
        whole = arrow_schema(schema)
        columns = list(zip(*out, strict=True)) if out else [()] * 9
        yield pa.record_batch(
            [
                *(batch.column(c) for c in ("conv_id", "part", "turn", "digest")),
                *(pa.array(c, f.type) for c, f in zip(columns, list(whole)[4:], strict=True)),
            ],
            schema=whole,
        )

    return in_arrow(rows.select("conv_id", "part", "turn", "digest", "codes", "end"), step, schema)


_NUMBERS = ("blank", "duplicate", "truncated", "illegal", "cost")
_PLAN = "turn {turn}, digest BINARY, letters STRING, " + ", ".join(f"{x} LONG" for x in _NUMBERS) + ", audit STRING"


def plans(found: DataFrame) -> DataFrame:
    """One row per segment: where it begins and its letters; a conversation's
    first segment also has the numbers and the audit of the whole."""
    conv, turn = found.schema["conv_id"].dataType, found.schema["turn"].dataType
    parts = T._parse_datatype_string(_TRACE.format(turn=turn.simpleString())).fieldNames()
    whole = (
        traced(found).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("parts"))
    )
    schema = T.StructType(
        [T.StructField("conv_id", conv)]
        + T._parse_datatype_string(_PLAN.format(turn=turn.simpleString())).fields
    )

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for row in batch.to_pylist():
            state, cost, letters = START, 0, []
            for part in row["parts"]:
                letters.append(part["audits"][state])
                cost += part["costs"][state]
                state = part["states"][state]
            letters[-1] += _TAIL[state]
            cost += INSERT * len(_TAIL[state])
            faults = [sum(p[name] for p in row["parts"]) for name in _NUMBERS[:4]]
            faults[3] += sum(
                (a["last"], b["first"]) not in _LEGAL for a, b in itertools.pairwise(row["parts"])
            )
            for i, part in enumerate(row["parts"]):
                own = [*faults, cost, "".join(letters)] if i == 0 else [None] * 6
                out.append((row["conv_id"], part["turn"], part["digest"], letters[i], *own))
        wide = arrow_schema(schema)
        columns = list(zip(*out, strict=True)) if out else [()] * len(wide)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, wide, strict=True)], schema=wide)

    return in_arrow(whole, step, schema)


# --- Repaired rows ---


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows in order, each segment's letters before its first row, a conversation in one task."""
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in found.schema if f.name not in ("conv_id", "turn", "digest")}
    texts = rows.select("conv_id", "turn", _digest().alias("digest"), "role", "text").withColumns(nothing)
    heads = found.withColumns({"role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    return (
        heads.unionByName(texts)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "digest", F.col("letters").isNull())
    )


class _Writer:
    """Follows the letters of one conversation and gives its repaired turns."""

    def __init__(self):
        self.letters, self.at, self.state = "", 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield _ROLE[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = _KEEP[self.state, INITIALS.find(role[:1])]
            yield role, text
        elif letter == "R":
            self.state = _NEXT[self.state]
            yield _ROLE[self.state], text


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired turns of rows, given the plans of their segments."""
    conv = found.schema["conv_id"].dataType
    schema = T.StructType(
        [T.StructField("conv_id", conv)] + T._parse_datatype_string("place LONG, role STRING, text STRING").fields
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, conv_id, place = None, None, 0
        for batch in batches:
            out = []

            def put(turns):
                nonlocal place
                for role, text in turns:
                    out.append((conv_id, place, role, text))  # noqa: B023
                    place += 1

            for row in batch.select(["conv_id", "letters", "audit", "role", "text"]).to_pylist():
                if row["letters"] is not None:
                    if writer is not None:
                        put(writer.inserted())
                    if row["audit"] is not None:
                        writer, conv_id, place = _Writer(), row["conv_id"], 0
                    writer.letters, writer.at = row["letters"], 0
                else:
                    put(writer.turn(row["role"], row["text"]))
            wide = arrow_schema(schema)
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, wide, strict=True)], schema=wide)
        if writer is not None:
            out = [(conv_id, place + i, role, text) for i, (role, text) in enumerate(writer.inserted())]
            wide = arrow_schema(schema)
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, wide, strict=True)], schema=wide)

    return _stream(rows, found).mapInArrow(run, schema)


def _hashed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The numbers and the audit of every conversation, with the hash of its repaired turns."""
    conv = found.schema["conv_id"].dataType
    schema = T.StructType(
        [T.StructField("conv_id", conv)]
        + T._parse_datatype_string(
            ", ".join(f"{x} LONG" for x in _NUMBERS) + ", audit STRING, repaired_sha256 STRING"
        ).fields
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = arrow_schema(schema)
        writer, head, told, started = None, None, None, False

        def put(turns):
            nonlocal started
            for role, text in turns:
                told.update(f"\n{role}:{text}".encode() if started else f"{role}:{text}".encode())
                started = True

        def finished():
            put(writer.inserted())
            return (*(head[c] for c in ("conv_id", *_NUMBERS, "audit")), told.hexdigest())

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["letters"] is None:
                    put(writer.turn(row["role"], row["text"]))
                elif row["audit"] is None:
                    put(writer.inserted())
                    writer.letters, writer.at = row["letters"], 0
                else:
                    if writer is not None:
                        out.append(finished())
                    writer, head, told, started = _Writer(), row, hashlib.sha256(), False
                    writer.letters = row["letters"]
            if out:
                yield pa.record_batch(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), wide, strict=True)], schema=wide
                )
        if writer is not None:
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip(finished(), wide, strict=True)], schema=wide)

    return _stream(rows, found).mapInArrow(run, schema)


def report(conversations: DataFrame) -> DataFrame:
    """Damages conversations, repairs them, and tells per conversation what it took."""
    all_rows = damage(conversations)
    rows = all_rows.where("NOT gone").drop("gone")
    turns = all_rows.groupBy("conv_id", "turn").agg(F.max(~F.col("gone")).alias("kept"))
    turn = F.when(F.col("kept"), F.col("turn"))
    every = turns.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(turn), F.lit(0)).cast("long").alias("gaps")
    )
    found = _hashed(rows, staged(plans(segments(rows))))
    empty = hashlib.sha256(b"").hexdigest()
    return _joined(every, found, ["conv_id"]).select(
        "conv_id",
        "gaps",
        *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in _NUMBERS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
