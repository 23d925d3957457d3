"""Line dedup by aligning pairs of documents.

A block is a run of consecutive lines that just reaches ``LEAST_WORDS`` words,
counted on from its first line or back from its last: all lines of any longer
common run lie in common blocks.  The first document that holds a block owns it.
Every document is aligned with the owners of its blocks by patience diff: common
ends, then lines that are unique in both, in their longest common order, then the
gaps between.  Runs of aligned lines with ``LEAST_WORDS`` words or more are deleted
from the later document.  A block that an alignment passes over, as it moved or is
repeated, is aligned by itself with its place in the owner, line by line.

So, whatever the number of holders, a line is deleted if and only if it lies in a
run of ``LEAST_WORDS`` words or more that an earlier document holds too; that is
all that the alignment of every pair would delete, and the moved blocks.  Pairs
grow with the documents and never with their square.

Documents are ordered by their key.  A line is compared without white space at
its ends, as a 64-bit hash; lines without a word are neither compared nor
deleted, nor do they end a run.

Only hashes are shuffled: one number per line.  Texts are joined with what is
deleted only by ``deduped``.

Defined cases: NULL and empty texts have no lines and stay; rows with a NULL
key are left as they are; rows with equal key and text are one document, with
equal key and other text they are ordered by a hash of the text; an empty
table gives no rows; ``deduped`` keeps all other columns as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclake.llm.shared import arrow_schema, in_arrow, staged

LEAST_WORDS = 12

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.struct(F.col(key).alias("id"), F.xxhash64(whole).alias("h")).alias("doc"),
        F.split(whole, "\n").alias("lines"),
    )


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: hash, words and place of every line that has a word."""
    rows = _keyed(docs, key, text).select(
        "doc",
        F.size("lines").alias("n_lines"),
        F.filter(
            F.transform(
                "lines",
                lambda line, i: F.struct(
                    F.xxhash64(F.regexp_replace(line, f"^{SPACE}|{SPACE}$", "")).alias("hash"),
                    F.regexp_count(line, F.lit(WORD)).alias("words"),
                    i.alias("place"),
                ),
            ),
            lambda x: x["words"] > 0,
        ).alias("line"),
    )
    return rows.select(
        "doc",
        "n_lines",
        F.col("line.hash").alias("hashes"),
        F.col("line.words").alias("words"),
        F.col("line.place").alias("places"),
    )


def blocks_of(hashes, words, starts, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last lines of all blocks of several documents, and the blocks' hashes.

    ``starts`` has the first line of each document and, as its last, the number of lines.
    """
    n = len(hashes)
    sums = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    each = np.arange(n)
    doc = np.searchsorted(starts, each, "right")
    ends = np.searchsorted(sums, sums[:-1] + least) - 1
    begins = np.searchsorted(sums, sums[1:] - least, "right") - 1
    ahead, back = ends < n, begins >= 0
    low = np.concatenate((each[ahead], begins[back]))
    high = np.concatenate((ends[ahead], each[back]))
    same = doc[low] == doc[high]
    low, high = low[same], high[same]
    value = (high - low + 1).astype(np.uint64)
    lines = np.asarray(hashes, np.int64).view(np.uint64)
    for step in range(int((high - low).max(initial=-1)) + 1):
        on = low + step <= high
        mixed = (value[on] ^ lines[low[on] + step]) * np.uint64(0x9E3779B97F4A7C15)
        value[on] = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return low, high, (value ^ (value >> np.uint64(32))).view(np.int64)


def _doc_type(lines: DataFrame) -> str:
    return f"STRUCT<id: {lines.schema['doc'].dataType['id'].dataType.simpleString()}, h: BIGINT>"


def _flat(column) -> np.ndarray:
    return np.asarray(column.flatten())


def _starts(column) -> np.ndarray:
    offsets = np.asarray(column.offsets)
    return offsets - offsets[0]


def owner_pairs(lines: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Pairs (early, late): every document with the owners of its blocks."""
    schema = f"doc {_doc_type(lines)}, blocks ARRAY<BIGINT>"
    shape = arrow_schema(schema)

    def step(batch):
        starts = _starts(batch.column(1))
        low, _, value = blocks_of(_flat(batch.column(1)), _flat(batch.column(2)), starts, least)
        order = np.argsort(low, kind="stable")
        offsets = np.searchsorted(low[order], starts).astype(np.int32)
        blocks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[order]))
        yield pa.record_batch([batch.column(0), blocks], schema=shape)

    rows = lines.where(F.col("doc.id").isNotNull()).select("doc", "hashes", "words")
    held = in_arrow(rows, step, schema).select(
        "doc", F.explode(F.array_distinct("blocks")).alias("hash")
    ).distinct()
    owned = (
        held.groupBy("hash")
        .agg(F.count("*").alias("n"), F.min("doc").alias("early"))
        .where("n > 1")
        .drop("n")
    )
    return (
        held.withColumnRenamed("doc", "late")
        .join(owned, "hash")
        .where(F.col("early") != F.col("late"))
        .select("early", "late")
        .distinct()
    )


def patience(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two lists, both rising."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        here = _once(x, a, b)
        there = _once(y, c, d)
        common = sorted((i, there[v]) for v, i in here.items() if v in there)
        chain = _rising(common)
        if not chain:
            continue
        out.extend(chain)
        low = (a, c)
        for i, j in [*chain, (b, d)]:
            if low[0] < i and low[1] < j:
                todo.append((low[0], i, low[1], j))
            low = (i + 1, j + 1)
    return sorted(out)


def _once(x: list[int], a: int, b: int) -> dict[int, int]:
    """Places of the values that come once in x[a:b]."""
    seen: dict[int, int] = {}
    for i in range(a, b):
        seen[x[i]] = -1 if x[i] in seen else i
    return {v: i for v, i in seen.items() if i >= 0}


def _rising(common: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part whose second places rise too."""
    from bisect import bisect_left

    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(common):
        at = bisect_left(tops, j)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[at], ends[at] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(common[n])
        n = before[n]
    return out[::-1]


def common_lines(x: list[int], y: list[int], words: list[int], least: int) -> list[int]:
    """Places in ``y`` of the aligned runs that have ``least`` words."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(x, y), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in run) >= least:
                out.extend(run)
            run = []
        run.append(j)
        last = (i, j)
    return out


def passed_over(early: _Lines, late: _Lines, aligned: np.ndarray, least: int) -> np.ndarray:
    """Marks lines of blocks that the alignment left out and the other document of the row holds."""
    low, high, value = blocks_of(late.hashes, late.words, late.starts, least)
    sums = np.concatenate(([0], np.cumsum(aligned)))
    left = sums[high + 1] - sums[low] <= high - low
    low, high, value = low[left], high[left], value[left]
    marks = aligned.copy()
    if not len(low):
        return marks
    at, until, known = blocks_of(early.hashes, early.words, early.starts, least)
    places = dict(zip(zip(early.rows(at).tolist(), known.tolist(), strict=True),
                      zip(at.tolist(), until.tolist(), strict=True), strict=True))
    for row, a, b, v in zip(late.rows(low).tolist(), low.tolist(), high.tolist(), value.tolist(), strict=True):
        c, d = places.get((row, v), (0, -1))
        if d - c == b - a and np.array_equal(early.hashes[c : d + 1], late.hashes[a : b + 1]):
            marks[a : b + 1] = True
    return marks


class _Lines:
    """Lines of one side of a batch of pairs."""

    def __init__(self, hashes, words):
        self.hashes, self.words, self.starts = _flat(hashes), _flat(words), _starts(hashes)

    def rows(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def deletions(lines: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Per document that loses lines: their places in the text, rising, and for each line
    of the text whether it goes."""
    # The owner's lines come last, so they are not shuffled once per pair.  Both sides of
    # that join are plain shuffles, as AQE splits a hot owner's rows only then.
    once = staged(lines.dropDuplicates(["doc"]))
    late = once.select(F.col("doc").alias("late"), "n_lines", "hashes", "words", "places")
    early = once.select(
        F.col("doc").alias("early"), F.col("hashes").alias("others"), F.col("words").alias("other_words")
    )
    rows = owner_pairs(lines, least).join(late, "late").join(early, "early").select(
        F.col("late").alias("doc"), "n_lines", "others", "other_words", "hashes", "words", "places"
    )
    schema = f"doc {_doc_type(lines)}, n_lines INT, gone ARRAY<INT>"
    shape = arrow_schema(schema)

    def align(batch):
        x = _Lines(batch.column(2), batch.column(3))
        y = _Lines(batch.column(4), batch.column(5))
        places = _flat(batch.column(6))
        aligned = np.zeros(len(y.hashes), bool)
        for n in range(batch.num_rows):
            a, b = y.starts[n], y.starts[n + 1]
            others = x.hashes[x.starts[n] : x.starts[n + 1]].tolist()
            found = common_lines(others, y.hashes[a:b].tolist(), y.words[a:b].tolist(), least)
            aligned[a + np.array(found, np.int64)] = True
        gone = np.flatnonzero(passed_over(x, y, aligned, least))
        offsets = np.searchsorted(gone, y.starts).astype(np.int32)
        taken = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places[gone], pa.int32()))
        yield pa.record_batch([batch.column(0), batch.column(1), taken], schema=shape)

    found = (
        in_arrow(rows, align, schema)
        .select("doc", "n_lines", F.explode("gone").alias("place"))
        .distinct()
        .groupBy("doc", "n_lines")
        .agg(F.sort_array(F.collect_list("place")).alias("gone"))
    )
    schema = f"doc {_doc_type(lines)}, gone ARRAY<INT>, goes ARRAY<BOOLEAN>"
    flagged = arrow_schema(schema)

    def flags(batch):
        ends = np.concatenate(([0], np.cumsum(np.asarray(batch.column(1), np.int64))))
        rows = np.repeat(np.arange(batch.num_rows), np.diff(_starts(batch.column(2))))
        goes = np.zeros(ends[-1], bool)
        goes[ends[rows] + _flat(batch.column(2))] = True
        each = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(goes))
        yield pa.record_batch([batch.column(0), batch.column(2), each], schema=flagged)

    return in_arrow(found, flags, schema)


def report(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    least: int = LEAST_WORDS,
) -> DataFrame:
    """Per document: key, n_lines, words, and number, words and places of deleted lines."""
    lines = staged(lines_of(docs, key, text))
    joined = lines.join(deletions(lines, least), "doc", "left")
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    taken = F.filter(F.arrays_zip("places", "words"), lambda x: F.get("goes", x["places"]))

    def total(words):
        return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + w)

    return joined.select(
        F.col("doc.id").alias(key),
        F.col("n_lines").cast("long").alias("n_lines"),
        total(F.col("words")).alias("n_words"),
        F.size(gone).cast("long").alias("n_deleted"),
        total(F.transform(taken, lambda x: x["words"])).alias("n_deleted_words"),
        gone.alias("deleted"),
    )


def deduped(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars",
    least: int = LEAST_WORDS,
) -> DataFrame:
    """The documents without the deleted lines; those that lose every word are left out."""
    lines = staged(lines_of(docs, key, text))
    gone = deletions(lines, least).select(
        F.col("doc.id").alias("_id"), F.col("doc.h").alias("_h"), "goes"
    )
    whole = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(
        gone, (F.col(f"row.`{key}`") == F.col("_id")) & (F.xxhash64(whole) == F.col("_h")), "left"
    )
    left = F.filter(F.split(whole, "\n"), lambda x, i: ~F.get("goes", i))
    out = joined.withColumn(
        "out", F.when(F.col("goes").isNull(), F.col(f"row.`{text}`")).otherwise(
            F.array_join(left, "\n"))
    ).where(F.col("goes").isNull() | F.col("out").rlike(WORD))
    columns = [
        F.col("out").alias(c)
        if c == text
        else F.when(F.col("goes").isNull(), F.col(f"row.`{c}`"))
        .otherwise(F.length("out").cast(docs.schema[c].dataType))
        .alias(c)
        if c == length
        else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return out.select(*columns)
