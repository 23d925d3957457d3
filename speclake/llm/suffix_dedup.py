"""Repeated passages by sparse suffix arrays.

Of all suffixes of all texts, those are kept that start at minimisers: the
least hash among ``WINDOW`` consecutive runs of ``RUN`` words, which depends on
the words alone, so equal passages keep equal suffixes.  A passage of
``least`` words holds a kept suffix at one of its first ``WINDOW`` places, so
its first ``least - WINDOW + 1`` words (the head) lie in the passage too.

1. Suffixes meet by the hash of their head; those whose head another document
   has too go on.  Only the least and greatest document of a head are kept
   while meeting, so a head in a third of all documents is combined before it
   is shuffled.
2. Where a run of such suffixes ends in a document, its last suffix extends to
   the right, its first to the left: all suffixes of that head are sorted by
   the words that follow, or by the words before read backwards, and compared
   with their neighbours of other documents; the match extends as far as they
   agree.  They are dealt by head and the first two words, so a hot head is
   spread over the tasks; a match of just one word is counted, not sorted.
3. Extended heads that touch are one span; spans of ``least`` words or more
   are reported, as places of words.

So every passage of ``least`` words that another document has is covered, and
every covered word lies in a repeat of at least the head's length.

Only hashes are shuffled, but for the texts that hold a repeated head, which
are read again once.

Defined cases: NULL and empty texts, and texts shorter than ``least``, have no
spans; repeats within one document do not count; rows with equal key and text
are one document; rows with a NULL key are documents by their text; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speclake.llm import words as W
from speclake.llm.shared import arrow_schema, in_arrow, staged

LEAST = 50
RUN = 8
WINDOW = 20
PART = 50_000  # sorted rows of one head that are compared at once
BYTES = 6  # of a word's hash in a context
WORD = r"[^\x20\x09-\x0D]+"


def minimisers(words: W.Words) -> np.ndarray:
    """Places, over all texts, of the least of every ``WINDOW`` consecutive runs."""
    runs = W.window_hashes(words.hashes, RUN)
    if len(runs) < WINDOW:
        return np.zeros(0, np.int64)
    first = np.arange(len(runs) - WINDOW + 1)
    least = np.lib.stride_tricks.sliding_window_view(runs, WINDOW).argmin(axis=1)
    owner = W.owners(words.bounds)
    within = owner[first] == owner[first + WINDOW + RUN - 2]
    return np.unique((first + least)[within])


def heads(words: W.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept places whose head of ``size`` words fits its text, their texts, head hashes."""
    places = minimisers(words)
    owner = W.owners(words.bounds)
    places = places[places + size <= len(words.hashes)]
    places = places[owner[places] == owner[places + size - 1]]
    hashes = W.window_hashes(words.hashes, size)
    return places, owner[places], hashes[places] if len(places) else np.zeros(0, np.uint64)


def _held(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("id"), F.xxhash64(whole).alias("h"), whole.alias("t"))


def _suffixes(held: DataFrame, size: int) -> DataFrame:
    """Kept suffixes: their head, place, and the heads before and after in the text."""
    schema = T.StructType(
        [
            held.schema["id"],
            *T._parse_datatype_string(
                "h LONG, head LONG, place INT, before LONG, after LONG"
            ).fields,
        ]
    )
    shape = arrow_schema(schema)

    def step(batch):
        for some in W.slices(batch, "t", W.PIECE):
            words = W.words_of(some.column(2), W.SPACED)
            places, owner, hashes = heads(words, size)
            texts, hashes = pa.array(owner), hashes.view(np.int64)
            apart = owner[1:] != owner[:-1]
            first, last = np.concatenate(([True], apart)), np.concatenate((apart, [True]))
            yield pa.record_batch(
                [
                    some.column(0).take(texts),
                    some.column(1).take(texts),
                    pa.array(hashes),
                    pa.array((places - words.bounds[owner]).astype(np.int32)),
                    pa.array(np.roll(hashes, 1), mask=first[: len(hashes)]),
                    pa.array(np.roll(hashes, -1), mask=last[: len(hashes)]),
                ],
                schema=shape,
            )

    return in_arrow(held, step, schema)


def _met(suffixes: DataFrame) -> DataFrame:
    """Heads that more than one document has."""
    doc = F.struct("id", "h")
    return (
        suffixes.groupBy("head")
        .agg(F.min(doc).alias("a"), F.max(doc).alias("b"))
        .where("a != b")
        .select("head")
    )


def _sorted_by(repeated: DataFrame, met: DataFrame) -> DataFrame:
    """Suffixes (id, h, place, side) to compare: those of heads where a run ends."""
    sides = []
    for side, near in ((False, "before"), (True, "after")):
        ends = (
            repeated.join(met.withColumnRenamed("head", near), near, "left_anti")
            .select("head")
            .distinct()
        )
        sides.append(
            repeated.join(ends, "head").select("id", "h", "place", F.lit(side).alias("side"))
        )
    return sides[0].unionByName(sides[1])


def _contexts(held: DataFrame, listed: DataFrame, size: int) -> DataFrame:
    """The listed suffixes, with the words before or after their heads as hashes."""
    by_doc = listed.groupBy("id", "h").agg(
        F.array_sort(F.collect_set(F.struct("place", "side"))).alias("at")
    )
    by_doc = by_doc.select(
        F.col("id").alias("_id"), F.col("h").alias("_h"), "at.place", "at.side"
    )
    rows = held.join(by_doc, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    rows = rows.select("id", "h", "t", "place", "side")
    schema = T.StructType(
        [
            held.schema["id"],
            *T._parse_datatype_string(
                "h LONG, place INT, side BOOLEAN, head LONG, near LONG, next LONG, context BINARY"
            ).fields,
        ]
    )
    shape = arrow_schema(schema)

    def step(batch):
        for some in W.slices(batch, "t", W.PIECE):
            words = W.words_of(some.column(2), W.SPACED)
            hashes = W.window_hashes(words.hashes, size)
            counts = np.diff(np.asarray(some.column(3).offsets))
            owner = np.repeat(np.arange(some.num_rows), counts)
            texts = pa.array(owner)
            places = some.column(3).flatten()
            sides = some.column(4).flatten()
            at = np.asarray(places, np.int64) + words.bounds[owner]
            contexts = [
                _context(words, i, t, after, size)
                for i, t, after in zip(at.tolist(), owner.tolist(), sides.to_pylist(), strict=True)
            ]
            firsts = [
                pa.array(
                    [int.from_bytes(c[k : k + BYTES]) if len(c) > k else None for c in contexts],
                    pa.int64(),
                )
                for k in (0, BYTES)
            ]
            yield pa.record_batch(
                [
                    some.column(0).take(texts),
                    some.column(1).take(texts),
                    places,
                    sides,
                    pa.array(hashes[at].view(np.int64) if len(at) else at),
                    *firsts,
                    pa.array(contexts, pa.binary()),
                ],
                schema=shape,
            )

    return in_arrow(rows, step, schema)


def _context(words: W.Words, place: int, text: int, after: bool, size: int) -> bytes:
    """Up to ``WINDOW`` words after a head, or before it from last to first."""
    low, high = int(words.bounds[text]), int(words.bounds[text + 1])
    if after:
        found = words.hashes[place + size : min(place + size + WINDOW, high)]
    else:
        found = words.hashes[max(low, place - WINDOW) : place][::-1]
    whole = np.ascontiguousarray(found).astype(">u8").view(np.uint8).reshape(-1, 8)
    return whole[:, :BYTES].tobytes()


def _agree(a: bytes, b: bytes) -> int:
    """Words from the start on which two contexts agree."""
    n = 0
    while n < min(len(a), len(b)) and a[n : n + BYTES] == b[n : n + BYTES]:
        n += BYTES
    return n // BYTES


def _extended(ends: DataFrame) -> DataFrame:
    """How many words each end's match extends."""
    doc = F.struct("id", "h")
    one = (
        ends.where("near IS NOT NULL")
        .groupBy("side", "head", "near")
        .agg(F.min(doc).alias("a"), F.max(doc).alias("b"))
        .where("a != b")
        .select("side", "head", "near", F.lit(1).alias("one"))
    )
    schema = T.StructType(
        [
            ends.schema["id"],
            *T._parse_datatype_string("h LONG, place INT, side BOOLEAN, words INT").fields,
        ]
    )
    shape = arrow_schema(schema)

    def compare(batches):
        """Rows come sorted; each is compared with the nearest of another document."""
        held: list[tuple] = []
        known: list[int] = []  # what held rows agree on with rows that are gone
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[3:5] + row[6:7] != held[-1][3:5] + held[-1][6:7]:
                    yield _batch(held, _best(held), known)
                    held, known = [], []
                held.append(row)
                known.append(0)
                if len(held) >= PART:
                    # The last document's rows, and one of another, go on.
                    cut = len(held) - 1
                    while cut > 0 and held[cut][:2] == held[-1][:2]:
                        cut -= 1
                    best = [max(x) for x in zip(_best(held), known, strict=True)]
                    yield _batch(held[:cut], best, best)
                    held, known = held[cut:], best[cut:]
        if held:
            yield _batch(held, _best(held), known)

    def _best(held):
        best = [0] * len(held)
        for order in (range(len(held)), range(len(held) - 1, -1, -1)):
            before, reach = None, 0
            for i in order:
                if before is not None:
                    step = _agree(held[before][5], held[i][5])
                    reach = step if held[before][:2] != held[i][:2] else min(reach, step)
                    best[i] = max(best[i], reach)
                before = i
        return best

    def _batch(rows, best, known):
        columns = list(zip(*[r[:4] for r in rows], strict=True)) or [(), (), (), ()]
        words = [max(best[i], known[i]) for i in range(len(rows))]
        return pa.record_batch(
            [pa.array(c, f.type) for c, f in zip(columns, list(shape)[:4], strict=True)]
            + [pa.array(words, pa.int32())],
            schema=shape,
        )

    sorted_ends = (
        ends.where("next IS NOT NULL")
        .select("id", "h", "place", "side", "head", "context", F.xxhash64("near", "next").alias("n"))
        .repartition("side", "head", "n")
        .sortWithinPartitions("side", "head", "n", "context", "id", "h")
    )
    more = sorted_ends.mapInArrow(compare, schema)
    ones = ends.join(one, ["side", "head", "near"]).select(
        "id", "h", "place", "side", F.col("one").alias("words")
    )
    return more.unionByName(ones).where("words > 0")


SPANS = "ARRAY<STRUCT<start: INT, end: INT>>"


def report(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST
) -> DataFrame:
    """Per document: key, n_words, n_repeated (words in spans), and the spans."""
    size = least - WINDOW + 1
    if size < RUN:
        raise ValueError(f"passages of fewer than {RUN + WINDOW - 1} words can't be found")
    held = _held(docs, key, text)
    suffixes = _suffixes(held, size)
    met = _met(suffixes)
    repeated = staged(suffixes.join(met, "head"))
    known = repeated.select("head").distinct()
    extended = _extended(staged(_contexts(held, _sorted_by(repeated, known), size)))
    every = (
        repeated.select("id", "h", "place", F.lit(False).alias("side"), F.lit(0).alias("words"))
        .unionByName(extended)
        .groupBy("id", "h")
        .agg(F.collect_set(F.struct("place", "side", "words")).alias("parts"))
    )
    # Extended heads by start; those that touch are joined.
    parts = F.array_sort(
        F.transform(
            "parts",
            lambda p: F.struct(
                (p["place"] - F.when(p["side"], 0).otherwise(p["words"])).alias("start"),
                (p["place"] + size + F.when(p["side"], p["words"]).otherwise(0)).alias("end"),
            ),
        )
    )
    empty = F.array().cast(SPANS)
    joined = F.aggregate(
        parts,
        F.struct(empty.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")),
        lambda a, p: F.when(
            p["start"] <= a["end"],
            F.struct(
                a["done"].alias("done"), a["start"].alias("start"),
                F.greatest(a["end"], p["end"]).alias("end"),
            ),
        ).otherwise(
            F.struct(
                F.when(
                    a["end"] - a["start"] >= least,
                    F.concat(a["done"], F.array(F.struct(a["start"], a["end"])).cast(SPANS)),
                ).otherwise(a["done"]).alias("done"),
                p["start"].alias("start"),
                p["end"].alias("end"),
            )
        ),
        lambda a: F.when(
            a["end"] - a["start"] >= least,
            F.concat(a["done"], F.array(F.struct(a["start"], a["end"])).cast(SPANS)),
        ).otherwise(a["done"]),
    )
    spans = every.select(F.col("id").alias("_id"), F.col("h").alias("_h"), joined.alias("spans"))
    counted = held.select("id", "h", F.regexp_count("t", F.lit(WORD)).alias("n_words"))
    rows = counted.join(
        spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left"
    )
    found = F.coalesce("spans", empty)
    return rows.select(
        F.col("id").alias(key),
        F.col("n_words").cast("long").alias("n_words"),
        F.aggregate(found, F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"]).alias(
            "n_repeated"
        ),
        found.alias("spans"),
    )
