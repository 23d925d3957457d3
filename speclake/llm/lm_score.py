"""Log-likelihood of whole documents under a recurrent model of the corpus.

Spark counts, trains and scores; `recurrent` is the model.

* **Counts.** Every word of every document is counted, combined per task before
  the shuffle.  The most frequent words, at most ``HEAVY`` of them whatever the
  corpus, go to every task; among them are all with a share of at least
  1 / ``HEAVY`` of all tokens, the only ones that a join by word could pile up.
  All others are joined by word, in parts of about ``JOINED`` distinct words.
* **Training.** Every training document is read once, in ``ROUNDS`` rounds dealt
  by checksum.  In a round each task starts from the same parameters, learns
  from its documents, and gives its parameters back; they are averaged, weighted
  by tokens, in slices of ``SLICE`` numbers, each slice a sum that combines
  before the shuffle.  So training grows with the corpus and its tasks.
* **Scoring.** Documents stream through lanes; the state is carried through a
  whole document.  A document's words without a place in the model belong to
  classes told by their last two bytes, and share their class's probability in
  proportion to count + 0.5, unknown words together as one more of count 0.  So
  the score is a log probability just as the base score is, over the same
  outcomes.

Only digests stand for words of more than ``LONGEST`` bytes.  Nulls: a NULL text
is an empty one, of one token (its end); a NULL doc_id counts as an empty string
for the checksum.  Repeated rows are scored, and learned from, each.  Without
training documents all words have count 0.  An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice, pairwise
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speclake.llm import recurrent
from speclake.llm import words as W
from speclake.llm.shared import arrow_schema, staged

FOLDS, HELD_OUT = 5, 1  # documents of this remainder are not learned from
HEAVY = 1 << 18
WORDS = 512  # words with an output of their own, the end among them
RARE = 16  # classes of other words
ROUNDS = 4
RATE = 0.02
LONGEST = 64
SLICE = 1024
DISTINCT = 1 << 19  # words a task counts before it hands them on
ROWS = 1 << 16  # of them at a time
JOINED = 1 << 18  # words a task holds to join others with their counts

END = b" "  # no word
_BLANKS = b" \t\n\v\f\r"
_LOWER = bytes(range(256)).lower()


class Lexicon(NamedTuple):
    """Counts as tasks need them: the heaviest words first, then classes of light ones."""

    numbers: dict[bytes, int]
    counts: np.ndarray  # training tokens of each heavy word
    tokens: int  # N
    distinct: int  # V
    rare_tokens: np.ndarray  # by class
    rare_distinct: np.ndarray
    shape: recurrent.Shape


class _Text(NamedTuple):
    """Words of several texts, A-Z lower-cased: split at \\x20 and \\x09-\\x0D only, ends left out."""

    words: pa.BinaryArray
    data: np.ndarray  # the words' bytes, one behind the other
    offsets: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]


def _text(column: pa.Array) -> _Text:
    data, texts = W.buffer_of(column)
    inside = ((data - np.uint8(9)) > 4) & (data != 32)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # Texts touch in the buffer; their words do not.
    borders = texts[1:-1][(texts[1:-1] > 0) & (texts[1:-1] < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = ends - starts
    kept = data.tobytes().translate(_LOWER, _BLANKS)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    long = np.flatnonzero(sizes > LONGEST)
    if len(long):
        parts, at = [], 0
        for i in long.tolist():
            parts += [kept[at : offsets[i]], END + hashlib.sha256(kept[offsets[i] : offsets[i + 1]]).digest()]
            at = offsets[i + 1]
            sizes[i] = len(parts[-1])
        kept = b"".join([*parts, kept[at:]])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(kept)]
    words = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), buffers)
    return _Text(words, np.frombuffer(kept, np.uint8), offsets, np.searchsorted(starts, texts, "left"))


def _words(text: str | None) -> list[bytes]:
    """One text's words, then the end."""
    return [*_text(pa.array([text], pa.string())).words.to_pylist(), END]


def _fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def _folded(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).select(
        "doc_id",
        "text",
        (_fold() % FOLDS == HELD_OUT).alias("held_out"),
        (F.floor(_fold() / FOLDS) % ROUNDS).cast("int").alias("round"),
    )


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n): tokens of each word in training documents, and in all."""
    schema = arrow_schema("word BINARY, c LONG, n LONG")

    def summed(parts: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(parts).group_by("word", use_threads=False)
        return rows.aggregate([("c", "sum"), ("n", "sum")]).rename_columns(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, parts, size = schema.empty_table(), [], 0
        for batch in batches:
            for some in W.slices(batch, "text"):
                for held in (False, True):
                    column = some.filter(pc.equal(some.column("held_out"), held)).column("text")
                    if not len(column):
                        continue
                    found = _text(column).words.value_counts()
                    words = pa.concat_arrays([found.field(0), pa.array([END], pa.binary())])
                    n = pa.concat_arrays([found.field(1), pa.array([len(column)], pa.int64())])
                    c = pa.array(np.zeros(len(n), np.int64)) if held else n
                    parts.append(pa.Table.from_arrays([words, c, n], schema=schema))
                    size += len(n)
            if size > DISTINCT:
                whole, parts, size = summed([whole, *parts]), [], 0
                if len(whole) > DISTINCT:
                    yield from whole.to_batches(ROWS)
                    whole = schema.empty_table()
        yield from summed([whole, *parts]).to_batches(ROWS)

    rows = _folded(docs).select("text", "held_out")
    return rows.mapInArrow(run, "word BINARY, c LONG, n LONG").groupBy("word").agg(
        F.sum("c").alias("c"), F.sum("n").alias("n")
    )


def lexicon(counts: DataFrame, heavy: int = HEAVY, words: int = WORDS, rare: int = RARE) -> Lexicon:
    """What tasks know of the counts: at most ``heavy`` words and the end, and a few sums."""
    total = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"),
        F.count_if(F.col("c") > 0).alias("distinct"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("all"),
    ).first()
    # n / all >= 1 / heavy holds for ``heavy`` words at most; as many more as there is room
    # for are taken in steps of the fourth root of two, so a few sums tell where to end.
    size = F.floor(F.log2("n") * 4)
    room, least = heavy, None
    for row in sorted(counts.groupBy(size.alias("size")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["size"]
    often = F.col("n") * heavy >= total["all"]
    if least is not None:
        often = often | (size >= least)
    found = counts.where(often | (F.col("word") == END)).select("word", "c").collect()
    found = sorted((-1 if w == END else 0, -c, bytes(w)) for w, c in found)
    if not found:
        found = [(-1, 0, END)]
    known = [w for _, _, w in found]
    counted = np.array([-c for _, c, _ in found], np.int64)
    own = max(1, min(words, int((counted > 0).sum())))
    member = counts.join(
        F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in known[:own]], "word BINARY")),
        "word",
        "left_anti",
    )
    by_class = (
        member.groupBy((F.crc32(F.substring("word", -2, 2)) % rare).alias("k"))
        .agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v"))
        .collect()
    )
    rare_tokens, rare_distinct = np.zeros(rare, np.int64), np.zeros(rare, np.int64)
    for k, c, v in by_class:
        rare_tokens[k], rare_distinct[k] = c, v
    return Lexicon(
        {w: i for i, w in enumerate(known)},
        counted,
        total["tokens"],
        total["distinct"],
        rare_tokens,
        rare_distinct,
        recurrent.Shape(own, rare),
    )


class _Reader:
    """Numbers of words: places among those known, and behind them a number for each class of others."""

    def __init__(self, known: pa.BinaryArray, rare: int):
        self.known, self.heavy, self.rare = known, len(known), rare
        # The class of a word is that of its last two bytes, or of its only one.
        self.two = np.array([crc32(bytes((a, b))) % rare for a in range(256) for b in range(256)], np.int32)
        self.one = np.array([crc32(bytes((b,))) % rare for b in range(256)], np.int32)

    def classes(self, text: _Text, some: np.ndarray) -> np.ndarray:
        """Classes of the words at these places."""
        ends, starts = text.offsets[some + 1], text.offsets[some]
        last = text.data[ends - 1]
        before = text.data[np.maximum(ends - 2, 0)].astype(np.int32)
        return np.where(ends - starts > 1, self.two[before * 256 + last], self.one[last])

    def read(self, text: _Text) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' words, each text's end behind them, and the texts' borders."""
        found = pc.index_in(text.words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        light = np.flatnonzero(found < 0)
        if len(light):
            found = found.copy()
            found[light] = self.heavy + self.classes(text, light)
        # The end is the first of all that are known.
        return np.insert(found, text.bounds[1:], 0), text.bounds + np.arange(len(text.bounds))


# --- Training ---


def _learn(rows: DataFrame, known: Lexicon, start: np.ndarray, rate: float) -> DataFrame:
    """(slice, weight, numbers): the parameters of every task after its documents."""
    schema = "slice INT, weight DOUBLE, numbers ARRAY<DOUBLE>"
    wide = arrow_schema(schema)
    shape = known.shape
    own = pa.array(islice(known.numbers, shape.words), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(own, shape.rare)
        like = recurrent.initial(shape, np.ones(shape.symbols))
        p = recurrent.unflat(start, like)

        def texts() -> Iterator[tuple[None, np.ndarray]]:
            for batch in batches:
                for some in W.slices(batch, "text"):
                    symbols, bounds = reader.read(_text(some.column("text")))
                    for a, b in pairwise(bounds.tolist()):
                        yield None, symbols[a:b].copy()  # else it holds all of its slice

        met, _ = recurrent.train(p, shape, recurrent.Adam(p, rate), texts())
        if met:
            whole = recurrent.flat(p).astype(np.float64)
            places = range(0, len(whole), SLICE)
            yield pa.record_batch(
                [
                    pa.array(range(len(places)), pa.int32()),
                    pa.array([float(met)] * len(places)),
                    pa.array([whole[i : i + SLICE] for i in places], pa.list_(pa.float64())),
                ],
                schema=wide,
            )

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, known: Lexicon, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """The model's parameters after one pass over all training documents."""
    shape = known.shape
    counts = np.concatenate((known.counts[: shape.words], known.rare_tokens)).astype(np.float64)
    now = recurrent.flat(recurrent.initial(shape, counts))
    rows = _folded(docs).where("NOT held_out")
    for turn in range(rounds):
        learned = _learn(
            rows.where((F.col("round") % rounds) == turn).select("text"), known, now, rate * (1 - turn / rounds)
        )
        mean = Summarizer.mean(array_to_vector("numbers"), F.col("weight"))
        # As many rows as the model has slices.
        found = learned.groupBy("slice").agg(vector_to_array(mean).alias("numbers")).collect()
        if found:
            now = np.concatenate([r.numbers for r in sorted(found)]).astype(np.float32)
    return now


# --- Scoring ---

_SCORED = (
    "row LONG, doc_id {key}, held_out BOOLEAN, n_tokens LONG, n_known LONG, base DOUBLE, score DOUBLE, "
    "light ARRAY<BINARY>"
)


def _read(docs: DataFrame, known: Lexicon, parameters: np.ndarray) -> DataFrame:
    """Every document's scores without the counts of its light words, and those words."""
    rows = _folded(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
    schema = T._parse_datatype_string(_SCORED.format(key=rows.schema["doc_id"].dataType.simpleString()))

    vocabulary = pa.array(known.numbers, pa.binary())
    known = known._replace(numbers=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = known.shape
        reader = _Reader(vocabulary, shape.rare)
        heavy, wide = reader.heavy, arrow_schema(schema)
        p = recurrent.unflat(parameters, recurrent.initial(shape, np.ones(shape.symbols)))
        classes = np.array([crc32(w[-2:]) % shape.rare for w in vocabulary.to_pylist()], np.int64)
        classes = np.concatenate((classes, np.arange(shape.rare)))
        number = np.arange(heavy + shape.rare)
        symbols = np.where(number < shape.words, number, shape.words + classes).astype(np.int32)
        # log10 of count + 0.5 (light words': added when counts are joined) and of the divisors.
        own = np.concatenate((np.log10(known.counts + 0.5), np.zeros(shape.rare)))
        base = own - np.log10(known.tokens + 0.5 * (known.distinct + 1))
        inside = own - np.log10(known.rare_tokens + 0.5 * (known.rare_distinct + 1))[classes]
        inside[: shape.words] = 0
        seen = np.concatenate((known.counts > 0, np.zeros(shape.rare, bool))).astype(np.int64)
        waiting: dict[int, tuple] = {}

        def texts() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for some in W.slices(batch, "text"):
                    text = _text(some.column("text"))
                    numbers, bounds = reader.read(text)
                    at = bounds[:-1]  # no text is without an end
                    light = np.flatnonzero(numbers >= heavy)
                    # Words have no ends between them, so a place is less by the texts before.
                    words = text.words.take(pa.array(light - np.searchsorted(bounds, light, "right") + 1))
                    cuts = np.searchsorted(light, bounds)
                    columns = zip(
                        some.column("doc_id").to_pylist(),
                        some.column("held_out").to_pylist(),
                        np.diff(bounds).tolist(),
                        *(np.add.reduceat(x[numbers], at).tolist() for x in (seen, base, inside)),
                        (words[a:b].to_pylist() for a, b in pairwise(cuts.tolist())),
                        strict=True,
                    )
                    all_symbols = symbols[numbers]
                    borders = pairwise(bounds.tolist())
                    for row, (a, b), values in zip(some.column("row").to_pylist(), borders, columns, strict=True):
                        waiting[row] = values
                        yield row, all_symbols[a:b].copy()

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, wide, strict=True)], schema=wide)

        out, size = [], 0
        for row, value in recurrent.score(p, shape, texts()):
            *head, rare, light = waiting.pop(row)
            out.append((row, *head, value / np.log(10) + rare, light))
            size += 1 + len(light)
            if size > 50_000:
                yield table(out)
                out, size = [], 0
        if out:
            yield table(out)

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, counts: DataFrame, known: Lexicon, parameters: np.ndarray) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document."""
    rows = staged(_read(docs, known, parameters))
    # Light words: fewer than 1 / HEAVY of all tokens each, so no task gets many rows of one word.
    light = rows.select("row", F.explode("light").alias("word"))
    c = F.coalesce("c", F.lit(0))
    # Every word has one row of counts, so parts of equal size are told by their number.
    parts = max(1, -(-counts.count() // JOINED))
    counted = counts.select("word", "c").repartition(parts, "word").hint("shuffle_hash")
    sums = (
        light.repartition(parts, "word")
        .join(counted, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.log10(c + F.lit(0.5))).alias("more"),
            F.count_if(c > 0).alias("met"),
        )
    )
    more = F.coalesce("more", F.lit(0.0))
    return (
        rows.drop("light")
        .join(sums, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
            F.lit(known.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + more).alias("base_score"),
            (F.col("score") + more).alias("score"),
        )
    )


def report(docs: DataFrame, heavy: int = HEAVY, words: int = WORDS) -> DataFrame:
    """Counts, learns and scores: all documents of a table."""
    counts = staged(word_counts(docs))
    known = lexicon(counts, heavy, words)
    return score(docs, counts, known, fit(docs, known))
