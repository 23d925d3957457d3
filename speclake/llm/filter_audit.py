"""What a chain of document filters removes, under every order of the filters.

A document's *mask* says which filters it fails.  Under an order of the filters
it is removed at the first filter of its mask.  The orders that begin with a
given prefix are neighbours in lexicographic order: their Lehmer ranks make one
interval of (n - k)! ranks.  So "a mask is removed at step k by filter f" holds
on a union of intervals, one per prefix of k - 1 filters outside the mask.  For
every step a difference array over the ranks takes a mask's count at the start
of each interval and gives it back at its end; one running sum over the 120
ranks then has all totals.  No document meets an order, only 32 counts per part
do.

Spark counts the masks: texts are read once (Arrow batches), and of a text only
its digest, its source and four answers go on.  The fifth filter, "equal to the
text of a smaller doc_id", needs no look at the members of a group of copies:
rows of one digest, part and label combine before the shuffle into a count, the
smallest doc_id and the rows at it.

Nulls: a NULL text is an empty one, a NULL source the part ``''``.  A row with a
NULL doc_id is never a copy, nor the original of one, and has no label.
Repeated rows count as often as they are there; those of the smallest doc_id
all pass the copy filter.  Repeated labels: one good (toxic) row is enough.
Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import permutations
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclake.llm.shared import arrow_schema, in_arrow

LEAST_WORDS = 50
LEAST_DISTINCT = 65  # percent of the words
MOST_CAPITALS = 5  # percent of the code points
SYMBOLS = b"#$%&*|"

WORDS, DISTINCT, CAPITALS, SYMBOL, COPY = (1 << i for i in range(5))  # filters A to E
_CAPITALS = ascii_uppercase.encode()

_ANSWERS = "doc_id LONG, part STRING, digest BINARY, mask INT"
_REPORT = (
    "part STRING, filter_order STRING, step INT, kept LONG, removed LONG, redundant LONG, "
    "unique_fails LONG, good_lost LONG, toxic_lost LONG, shapley LONG"
)


def own_failures(text: str) -> int:
    """The filters a text fails by itself, as bits: few words, few distinct ones, capitals, symbols."""
    data = text.encode()
    words = data.split()  # bytes split at \x20 and \x09-\x0D only
    mask = WORDS if len(words) < LEAST_WORDS else 0
    if 100 * len(set(words)) < LEAST_DISTINCT * len(words):
        mask |= DISTINCT
    if 100 * (len(data) - len(data.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text):
        mask |= CAPITALS
    if len(data.translate(None, SYMBOLS)) < len(data):
        mask |= SYMBOL
    return mask


def answers(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest of the text, mask without the copy filter) of every document."""
    schema = arrow_schema(_ANSWERS)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            found.append((hashlib.sha256(text.encode()).digest(), own_failures(text)))
        digests, masks = zip(*found, strict=True) if found else ((), ())
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                batch.column("part"),
                pa.array(digests, pa.binary()),
                pa.array(masks, pa.int32()),
            ],
            schema=schema,
        )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.col("text").cast("string").alias("text"),
    )
    return in_arrow(rows, step, _ANSWERS)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail just these filters."""
    rows = answers(docs)
    tags = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
    )
    key = ["digest", "part", "mask", "good", "toxic"]
    # Rows of one document first: a join by doc_id then meets every document once.
    seen = (
        rows.where("doc_id IS NOT NULL")
        .groupBy("doc_id", "digest", "part", "mask")
        .agg(F.count("*").alias("n"))
        .join(tags, "doc_id", "left")
        .fillna(False, ["good", "toxic"])
        .groupBy(*key)
        .agg(
            F.sum("n").alias("n"),
            F.min("doc_id").alias("least"),
            F.min_by("n", "doc_id").alias("at_least"),
        )
    )
    # A digest has at most four rows per part now.
    least = seen.groupBy("digest").agg(F.min("least").alias("first"))
    first = F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(F.lit(0))
    known = seen.join(least, "digest").select(
        "part", "mask", "good", "toxic", "n", first.cast("long").alias("first")
    )
    copies = known.groupBy("part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum("first").alias("first")
    )
    unknown = (
        rows.where("doc_id IS NULL")
        .groupBy("part", "mask")
        .agg(F.count("*").alias("n"))
        .select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    )
    return (
        copies.select("part", "mask", "good", "toxic", F.col("first").alias("n"))
        .unionByName(
            copies.select(
                "part",
                F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"),
                "good",
                "toxic",
                (F.col("n") - F.col("first")).alias("n"),
            )
        )
        .unionByName(unknown)
        .where("n > 0")
    )


def removal_intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, start, end): the ranks of orders under which the mask goes at that step."""
    found = []

    def walk(prefix: tuple[int, ...], rest: tuple[int, ...], start: int) -> None:
        """``prefix`` removes nothing of the masks that avoid it; ``rest`` is in order."""
        width = math.factorial(len(rest) - 1)
        for place, f in enumerate(rest):
            at = start + place * width  # Lehmer digit times the factorial
            others = rest[:place] + rest[place + 1 :]
            for pick in range(1 << len(others)):
                mask = 1 << f | sum(1 << g for i, g in enumerate(others) if pick >> i & 1)
                found.append((mask, len(prefix), at, at + width))
            if others:
                walk((*prefix, f), others, at)

    walk((), tuple(range(n)), 0)
    return found


def audit(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, good, toxic, n).

    ``names`` holds one letter per bit of the masks, in ascending order; the
    orders come in lexicographic order of their letters.  A part is one row of
    at most 4 * 2^n counts before it gets here.
    """
    n = len(names)
    intervals = np.array(removal_intervals(n), dtype=np.int64).reshape(-1, 4)
    orders = list(permutations(range(n)))
    spelled = ["".join(names[f] for f in order) for order in orders]
    filters = np.array(orders).T  # [step, rank]
    schema = arrow_schema(_REPORT)

    def totals(cells: list[dict]) -> dict[str, np.ndarray]:
        number = np.zeros((3, 1 << n), np.int64)  # all, good, toxic ones by mask
        for cell in cells:
            for row, counted in enumerate((True, cell["good"], cell["toxic"])):
                if counted:
                    number[row, cell["mask"]] += cell["n"]
        steps = np.zeros((3, n, len(orders) + 1), np.int64)
        mask, step, start, end = intervals.T
        for row in range(3):
            np.add.at(steps[row], (step, start), number[row, mask])
            np.add.at(steps[row], (step, end), -number[row, mask])
        removed, good, toxic = np.cumsum(steps, axis=2)[:, :, :-1]
        masks = np.arange(1 << n)
        failing = np.array([number[0, masks >> f & 1 == 1].sum() for f in range(n)])
        alone = np.array([number[0, 1 << f] for f in range(n)])
        over_all = np.array([removed[filters == f].sum() for f in range(n)])
        return {
            "kept": number[0].sum() - np.cumsum(removed, axis=0),
            "removed": removed,
            "redundant": failing[filters] - removed,
            "unique_fails": alone[filters],
            "good_lost": good,
            "toxic_lost": toxic,
            "shapley": over_all[filters],
        }

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            found = totals(row["cells"])
            size = n * len(orders)
            yield pa.record_batch(
                [
                    pa.array([row["part"]] * size, pa.string()),
                    pa.array([s for s in spelled for _ in range(n)], pa.string()),
                    pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))),
                    *(pa.array(values.T.reshape(-1)) for values in found.values()),
                ],
                schema=schema,
            )

    parts = (
        counts.groupBy("part", "mask", "good", "toxic")
        .agg(F.sum("n").alias("n"))
        .groupBy("part")
        .agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    )
    return in_arrow(parts, step, _REPORT)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole documents, under all 120 orders."""
    return audit(mask_counts(docs, labels))
