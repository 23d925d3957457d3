"""Benchmark decontamination: a broadcast set of normalised n-grams.

Benchmark items become windows of ``width`` consecutive words (an item of
fewer words is one window).  The windows' hashes are broadcast; each document
is read once, its words' windows are looked up, hits are compared word by word
with the benchmark's, and every word inside a true hit is marked.

Bound of the broadcast: at most ``block`` windows (the default takes about
100 MB with their texts).  The windows are counted first.  A larger benchmark
is cut into blocks by hash; each block scans all documents, and the hits of
all blocks are united per document.

Defined cases: NULL and empty texts have no words and no hits; NULL or empty
items have no windows; equal items each count; repeated rows are each judged;
an empty benchmark leaves everything clean; other columns are never read in
reports and are passed through as they are by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speclake.llm import words as W
from speclake.llm.shared import arrow_schema, in_arrow

WIDTH = 10
BLOCK = 500_000

WINDOWS = "hash LONG, n INT, item STRING, words BINARY"
SPANS = "ARRAY<STRUCT<start: LONG, end: LONG>>"
REPORT = "n_words LONG, n_hit LONG, items ARRAY<STRING>"
HITS = f"text_key LONG, n_words LONG, items ARRAY<STRING>, spans {SPANS}"


def _joined(found: W.Words, low: int, n: int) -> bytes:
    """The words low, low + 1, ... as one line, A-Z lower-cased."""
    return b" ".join(
        bytes(W.LOWER[found.data[s:e]])
        for s, e in zip(found.starts[low : low + n], found.ends[low : low + n], strict=True)
    )


def benchmark_windows(items: DataFrame, item: str, text: str, width: int = WIDTH) -> DataFrame:
    """One row per distinct window of an item."""
    schema = arrow_schema(WINDOWS)

    def step(batch):
        found = W.words_of(batch.column(1), W.ALNUM, lower=True)
        rows = set()
        for i, name in enumerate(batch.column(0).to_pylist()):
            low, high = int(found.bounds[i]), int(found.bounds[i + 1])
            n = min(width, high - low)
            if not n:
                continue
            hashes = W.window_hashes(found.hashes[low:high], n).view(np.int64)
            rows |= {
                (int(h), n, name, _joined(found, low + k, n)) for k, h in enumerate(hashes)
            }
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                              schema=schema)

    named = items.select(F.col(item).cast("string"), F.col(text).cast("string"))
    return in_arrow(named, step, WINDOWS).distinct()


class Ngrams:
    """The windows of one block, ready to look up."""

    def __init__(self, rows):
        self.items = sorted({r.item for r in rows if r.item is not None} | {""})
        number = {name: i for i, name in enumerate(self.items)}
        texts = defaultdict(lambda: defaultdict(set))
        lengths = defaultdict(set)
        for r in rows:
            texts[np.uint64(r.hash & W._M64)][bytes(r.words)].add(number[r.item or ""])
            lengths[r.n].add(r.hash & W._M64)
        self.texts = {h: {t: sorted(i) for t, i in by.items()} for h, by in texts.items()}
        self.lengths = {n: np.sort(np.array(list(h), np.uint64)) for n, h in lengths.items()}
        # One bit per low part of a hash, so most windows need no search.
        self.bits = {n: _bits(h) for n, h in self.lengths.items()}

    def hits(self, found: W.Words):
        """(first word, n, items) of every window that a benchmark item holds."""
        owner = W.owners(found.bounds)
        for n, known in self.lengths.items():
            windows = W.window_hashes(found.hashes, n)
            if not len(windows):
                continue
            near = np.flatnonzero(self.bits[n][(windows & np.uint64(_LOW)).astype(np.int64)])
            near = near[owner[near] == owner[near + n - 1]]
            at = np.minimum(np.searchsorted(known, windows[near]), len(known) - 1)
            for low in near[known[at] == windows[near]]:
                items = self.texts[windows[low]].get(_joined(found, int(low), n))
                if items:
                    yield int(low), n, items


_LOW = (1 << 22) - 1


def _bits(hashes: np.ndarray) -> np.ndarray:
    table = np.zeros(_LOW + 1, bool)
    table[(hashes & np.uint64(_LOW)).astype(np.int64)] = True
    return table


def _marked(ngrams: Ngrams, column: pa.Array):
    """Words of the texts, which of them are hit, and the items per text."""
    found = W.words_of(column, W.ALNUM, lower=True)
    hit = np.zeros(len(found.hashes) + 1, np.int64)
    items = defaultdict(set)
    for low, n, names in ngrams.hits(found):
        hit[low] += 1
        hit[low + n] -= 1
        items[int(np.searchsorted(found.bounds, low, "right")) - 1].update(names)
    return found, np.cumsum(hit[:-1]) > 0, items


def _runs(hit: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge.reshape(-1, 2)


def _blocks(windows: DataFrame, block: int) -> list[DataFrame]:
    windows = windows.cache()
    n = max(1, -(-windows.count() // block))
    if n == 1:
        return [windows]
    return [windows.where(F.pmod("hash", F.lit(n)) == i) for i in range(n)]


def _sent(part: DataFrame):
    """A block, sent to all executors; it has a bounded number of windows."""
    return part.sparkSession.sparkContext.broadcast(Ngrams(part.collect()))


def _held(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))


def _scan(held: DataFrame, part: DataFrame) -> DataFrame:
    """Hits of one block: the key, a key of the text, words, items and word spans."""
    sent = _sent(part)
    schema = T.StructType(
        [held.schema["key"], *T._parse_datatype_string(HITS).fields]
    )
    shape = arrow_schema(schema)

    def step(batch):
        for some in W.slices(batch, "text"):
            found, hit, items = _marked(sent.value, some.column("text"))
            names = sent.value.items
            spans, keys = [], []
            for i, (low, high) in enumerate(zip(found.bounds[:-1], found.bounds[1:], strict=True)):
                near = _runs(hit[low:high]) if i in items else ()
                spans.append([{"start": int(a), "end": int(b)} for a, b in near])
                keys.append(_text_key(some.column("text")[i].as_py()) if len(near) else None)
            yield pa.record_batch(
                [
                    some.column("key"),
                    pa.array(keys, pa.int64()),
                    pa.array(np.diff(found.bounds).astype(np.int64)),
                    pa.array([sorted(names[k] for k in items.get(i, ())) for i in range(len(spans))],
                             shape.field("items").type),
                    pa.array(spans, shape.field("spans").type),
                ],
                schema=shape,
            )

    return in_arrow(held, step, schema)


def _text_key(text: str | None) -> int:
    digest = hashlib.blake2b((text or "").encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block: int = BLOCK,
) -> DataFrame:
    """Per document: key, n_words, n_hit, items (sorted as strings) and word spans."""
    held = _held(docs, key, text)
    parts = _blocks(benchmark_windows(benchmark, item, item_text, width), block)
    found = [_scan(held, part) for part in parts]
    if len(found) == 1:
        rows = found[0]
    else:
        # One row per block and document: only those with hits are united.
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        hits = (
            every.where(F.size("items") > 0)
            .groupBy("key", "text_key")
            .agg(
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                F.flatten(F.collect_list("spans")).alias("spans"),
            )
        )
        counted = _counted(held)
        rows = counted.join(
            hits.select(
                F.col("key").alias("_k"), F.col("text_key").alias("_t"), "items", "spans"
            ),
            F.col("key").eqNullSafe(F.col("_k")) & (F.col("text_key") == F.col("_t")),
            "left",
        ).withColumns(
            {
                "items": F.coalesce("items", F.array().cast("array<string>")),
                "spans": F.coalesce("spans", F.array().cast(SPANS)),
            }
        )
    marked = F.array_distinct(
        F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    )
    return rows.select(
        F.col("key").alias(key),
        "n_words",
        F.when(F.size("spans") == 0, F.lit(0)).otherwise(F.size(marked)).cast("long").alias("n_hit"),
        "items",
        "spans",
    )


def _counted(held: DataFrame) -> DataFrame:
    schema = T.StructType(
        [held.schema["key"], *T._parse_datatype_string("text_key LONG, n_words LONG").fields]
    )
    shape = arrow_schema(schema)

    def step(batch):
        for some in W.slices(batch, "text"):
            found = W.words_of(some.column("text"), W.ALNUM)
            keys = [_text_key(t) for t in some.column("text").to_pylist()]
            yield pa.record_batch(
                [some.column("key"), pa.array(keys, pa.int64()),
                 pa.array(np.diff(found.bounds).astype(np.int64))],
                schema=shape,
            )

    return in_arrow(held, step, schema)


def remove(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    what: str = "documents",
    width: int = WIDTH,
    block: int = BLOCK,
) -> DataFrame:
    """The documents, with all their columns, without contaminated text.

    ``what``: ``documents`` leaves out those with any hit, ``spans`` cuts the
    hit words out of the text, with the white space after them.
    """
    if what not in ("documents", "spans"):
        raise ValueError(f"what to remove: documents or spans, not {what!r}")
    shape = arrow_schema(docs.schema)
    place = docs.columns.index(text)

    def step(batch, sent):
        for some in W.slices(batch, text):
            found, hit, items = _marked(sent.value, some.column(place))
            if not items:
                yield some
            elif what == "documents":
                yield some.filter(pa.array([i not in items for i in range(some.num_rows)]))
            else:
                yield _cut(some, found, hit, items)

    def _cut(some, found, hit, items):
        texts = some.column(place).to_pylist()
        _, offsets = W.buffer_of(some.column(place))
        for i in items:
            low, high = int(found.bounds[i]), int(found.bounds[i + 1])
            whole, at, kept = bytes(found.data[offsets[i] : offsets[i + 1]]), 0, []
            for a, b in _runs(hit[low:high]):
                kept.append(whole[at : found.starts[low + a] - offsets[i]])
                at = int(found.ends[low + b - 1] - offsets[i])
                while at < len(whole) and whole[at] in b" \t\n\v\f\r":
                    at += 1
            texts[i] = b"".join([*kept, whole[at:]]).decode()
        columns = some.columns
        columns[place] = pa.array(texts, shape.field(place).type)
        return pa.record_batch(columns, schema=shape)

    rows = docs
    for part in _blocks(benchmark_windows(benchmark, item, item_text, width), block):
        sent = _sent(part)
        rows = in_arrow(rows, lambda batch, sent=sent: step(batch, sent), docs.schema)
    return rows


def digest(report: DataFrame, key: str = "doc_id") -> DataFrame:
    """The report with its items as a count and a hash."""
    return report.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
