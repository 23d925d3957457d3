"""Token ids as binary segments with Elias-Fano document boundaries.

Documents are encoded, dealt to ranges of the key, sorted there, and written
as segments: one concatenated id array per segment, whose document boundaries
(and keys) are Elias-Fano coded.  A boundary costs about two bits more than
the logarithm of a document's length; ``select`` with sampled places finds any
of them, so no table of 64-bit offsets is kept.

Segments are rows of a Parquet table, written by Spark's own committer: a task
that is lost is run again and leaves nothing behind, in any store Spark knows.

    segment = magic, id width, low-bit counts, numbers of documents and ids,
              boundaries (low bits, high bits, samples), keys (same), ids

A segment has at most ``IDS`` ids or one document.  A segment's place in the
whole is its range's start plus the ids before it in the range; the starts are
one number per range.

Defined cases: NULL and empty texts have only the end id; rows with a NULL key
come first, in segments of their own; repeated rows are each written; an empty
table gives no segments; other columns are left out.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speclake.llm import words as W
from speclake.llm.shared import Kept, arrow_schema, in_arrow, shared_folder

MAGIC = b"IDEF"
SAMPLE = 256  # every 256th boundary's place is kept
IDS = 1 << 20  # ids per segment
RANGE_BYTES = 16 << 20  # text bytes per range of the key
MARKS = ".,;:!?*$%&#"
KEPT = 120_000  # words of each of two generations
# Letters that stand for themselves in every normal form, then a few marks.
PLAIN = re.compile(rf"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(MARKS)}]{{0,3}})")


class EliasFano:
    """Numbers in rising order, equal ones allowed, in near-minimal space."""

    def __init__(self, low_bits: int, n: int, low: bytes, high: bytes, samples: bytes):
        self.low_bits, self.n = low_bits, n
        self.low, self.high, self.samples = low, high, np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // n).bit_length() - 1) if n and most else 0
        values = values.astype(np.uint64)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        marks[places] = 1
        high = np.packbits(marks, bitorder="little").tobytes()
        return cls(low_bits, n, low, high, places[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """Place of the i-th mark: from the nearest sample on, byte by byte."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        at = place >> 3
        byte = self.high[at] >> (place & 7) << (place & 7)
        while left >= byte.bit_count():
            left -= byte.bit_count()
            at += 1
            byte = self.high[at]
        for _ in range(left):
            byte &= byte - 1
        return at * 8 + (byte & -byte).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        near = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3], "little")
        low = (near >> (first & 7)) & ((1 << self.low_bits) - 1)
        return ((self.select(i) - i) << self.low_bits) | low

    def all(self) -> np.ndarray:
        """All numbers."""
        marks = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        out = (marks[: self.n] - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")
            bits = bits[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
            for k in range(self.low_bits):
                out |= bits[:, k] << np.uint64(k)
        return out.astype(np.int64)

    def packed(self) -> bytes:
        parts = (self.low, self.high, self.samples.tobytes())
        return struct.pack("<BIIII", self.low_bits, self.n, *map(len, parts)) + b"".join(parts)

    @classmethod
    def unpacked(cls, data: memoryview) -> tuple[EliasFano, memoryview]:
        head = struct.calcsize("<BIIII")
        low_bits, n, *sizes = struct.unpack("<BIIII", data[:head])
        parts, at = [], head
        for size in sizes:
            parts.append(bytes(data[at : at + size]))
            at += size
        return cls(low_bits, n, *parts), data[at:]


class Segment:
    """Some documents' ids, one after the other."""

    def __init__(self, ends: EliasFano, keys: EliasFano | None, first_key: int, ids: np.ndarray):
        self.ends, self.keys, self.first_key, self.ids = ends, keys, first_key, ids

    @classmethod
    def packed(cls, keys: list[int | None], ids: list[np.ndarray]) -> bytes:
        """``keys`` in rising order, or all NULL."""
        whole = np.concatenate(ids)
        width = 2 if not len(whole) or whole.max() < 1 << 16 else 4
        ends = EliasFano.of(np.cumsum([len(i) for i in ids]))
        null = keys[0] is None
        first = 0 if null else keys[0]
        head = MAGIC + struct.pack("<BBqQ", width, null, first, len(whole))
        coded = b"" if null else EliasFano.of(np.array([k - first for k in keys], np.uint64)).packed()
        return head + ends.packed() + coded + whole.astype(f"<u{width}").tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Segment:
        if data[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        width, null, first, _ = struct.unpack("<BBqQ", data[4:22])
        ends, rest = EliasFano.unpacked(memoryview(data)[22:])
        keys = None
        if not null:
            keys, rest = EliasFano.unpacked(rest)
        return cls(ends, keys, first, np.frombuffer(rest, f"<u{width}"))

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def document(self, i: int) -> np.ndarray:
        low, high = self.bounds(i)
        return self.ids[low:high]


class Encoder:
    """Ids of texts by the tokenizers library.

    Where the tokenizer drops white space, words are encoded alone and the ids
    of words met lately are kept; else texts go in whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        self.mark = next(((i, t.content) for i, t in sorted(special.items())), None)
        self.specials = [t.content for t in special.values()]
        probe = "Abc def's \n\tx  12 y\r\nÉa ß\n"
        apart = [i for w in probe.replace("\n", " ").split(" ") for i in self._ids(w)]
        self.by_word = self.mark is not None and apart == self._ids(probe)
        lower = self._ids(probe.lower()) == self._ids(probe)
        self.folds = lower and self._ids("ABCDEFGHIJKLMNOPQRSTUVWXYZ") == self._ids(
            "abcdefghijklmnopqrstuvwxyz"
        )
        self.known = Kept(KEPT)
        # Ids that end a run of letters, where the vocabulary marks them so.
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

        self.model = self.tokenizer.model
        self.marks: dict[str, list[int]] = {"": []}
        letters = [chr(c) for c in range(256) if PLAIN.fullmatch(chr(c))]
        # Bytes of these letters that byte-level vocabularies write as other characters.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        held = set("".join(letters).lower().encode())
        self.letters = [(chr(b), chr(256 + i)) for i, b in enumerate(hidden) if b in held]
        probes = [*letters, "".join(letters), "The", "token", "Straße", "über", "niño", "ÉCOLE", *map("a{}b".format, letters)]
        self.direct = self.folds and bool(self.ends.any()) and all(self._core(w) == self._ids(w) for w in probes)

    def _core(self, letters: str) -> list[int]:
        """Ids of a run of letters, by the library's model alone: normalising and cutting leave it as it is."""
        low = letters.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1")
            for byte, letter in self.letters:
                low = low.replace(byte, letter)
        return [token.id for token in self.model.tokenize(low)]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learnt(self, new: list[str]) -> list[bytes]:
        """Ids of words: runs of plain letters, with marks after them or not, by the model alone."""
        if not self.direct:
            return self._learnt_by_text(new)
        match, core, marks, tokenize = PLAIN.fullmatch, self._core, self.marks, self.model.tokenize
        ids: list[int] = []
        ends, other = [0], []
        for w in new:
            found = match(w)
            if found is None:
                other.append(w)
            else:
                letters, after = found.groups()
                ids += [t.id for t in tokenize(letters.lower())] if letters.isascii() else core(letters)
                if after:
                    if after not in marks:
                        marks[after] = self._ids(after)
                    ids += marks[after]
            ends.append(len(ids))
        data = np.array(ids, "<u4").tobytes()
        learnt = [data[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]
        if other:
            rest = dict(zip(other, self._learnt_by_text(other), strict=True))
            learnt = [rest.get(w, known) for w, known in zip(new, learnt, strict=True)]
        return learnt

    def _learnt_by_text(self, new: list[str]) -> list[bytes]:
        """Ids of words.

        A run of letters and the marks after it are encoded apart by the
        tokenizers that drop white space, so words are cut there, and runs of
        letters go to the library joined by blanks: each ends with an end id.
        """
        if not self.ends.any():
            return self._learnt_whole(new)
        cut = [(w, w.rstrip(MARKS)) for w in new]
        plain = {
            c for _, c in cut
            if c and c.isalpha() and (c.isascii() or is_normalized("NFC", c) and c.lower().isalpha())
        }
        found: dict[str, bytes] = {"": b""}
        cores = list(plain)
        for at in range(0, len(cores), 2000):
            some = cores[at : at + 2000]
            ids = np.array(self._ids(" ".join(some)), "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                found.update(zip(some, self._learnt_whole(some), strict=True))
                continue
            data, low = ids.tobytes(), 0
            for w, high in zip(some, (4 * ends).tolist(), strict=True):
                found[w] = data[low:high]
                low = high
        rest = {w for w, c in cut if c not in plain}
        rest |= {w[len(c) :] for w, c in cut if c in plain}
        rest.discard("")
        rest = list(rest)
        found.update(zip(rest, self._learnt_whole(rest), strict=True))
        return [found[c] + found[w[len(c) :]] if c in plain else found[w] for w, c in cut]

    def _learnt_whole(self, new: list[str]) -> list[bytes]:
        """Ids of any words: joined by a special token, so the library is called seldom."""
        number, mark = self.mark
        plain = [w for w in new if w and not any(s in w for s in self.specials)]
        found = {w: np.array(self._ids(w), "<u4").tobytes() for w in set(new).difference(plain)}
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = np.array(self._ids(mark.join(some)), "<u4")
            cut = np.flatnonzero(ids == number)
            data, low = ids.tobytes(), 0
            for w, high in zip(some, [*cut.tolist(), len(ids)], strict=True):
                found[w] = data[4 * low : 4 * high]
                low = high + 1
        return [found[w] for w in new]

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        cut = []
        for t in texts:
            if self.folds and t.isascii() and "<" not in t:
                t = t.lower()
            cut.append(t.replace("\n", " ").split(" "))
        known = self.known.of(set().union(*cut), self._learnt)
        return [b"".join([known[w] for w in words]) for words in cut]


_loaded: dict[str, Encoder] = {}


def loaded(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def write(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str,
    key: str = "doc_id", text: str = "text",
) -> None:
    """Writes the documents' ids to ``folder``, in rising order of the key."""
    held = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("t"))
    size = held.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, size // RANGE_BYTES)
    shares = [i / n for i in range(1, n)]
    bounds = held.agg(F.percentile_approx("key", shares, 20 * n)).first()[0] if shares else None
    borders = np.unique(np.array(bounds or [], np.int64))
    encoded = "range INT, key LONG, ids BINARY"
    shape = arrow_schema(encoded)
    tail = np.array([end_id], "<u4").tobytes()

    def encode(batch):
        encoder = loaded(tokenizer)
        for some in W.slices(batch, "t", W.PIECE):
            keys = some.column(0)
            place = np.searchsorted(borders, keys.fill_null(-(1 << 63)).to_numpy(), "right")
            ids = encoder.encoded([t or "" for t in some.column(1).to_pylist()])
            yield pa.record_batch(
                [pa.array(place.astype(np.int32)), keys, pa.array([i + tail for i in ids], pa.binary())],
                schema=shape,
            )

    dealt = (
        in_arrow(held, encode, encoded)
        .repartition(int(n), "range")
        .sortWithinPartitions("range", F.col("key").asc_nulls_first(), "ids")
    )
    segments = "range INT, before LONG, n_docs LONG, n_ids LONG, segment BINARY"
    out = arrow_schema(segments)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        range_, before, size = None, 0, 0

        def row():
            return pa.record_batch(
                [[range_], [before], [len(keys)], [size], [Segment.packed(keys, ids)]], schema=out
            )

        for batch in batches:
            for r, k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(data, "<u4")
                apart = keys and (
                    r != range_ or size + len(own) > IDS or (keys[-1] is None) != (k is None)
                )
                if apart:
                    yield row()
                    before, size = before + size, 0
                    keys, ids = [], []
                if r != range_:
                    range_, before = r, 0
                keys.append(k)
                ids.append(own)
                size += len(own)
        if keys:
            yield row()

    dealt.mapInArrow(pack, segments).write.parquet(folder)


def read(spark: SparkSession, folder: str, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Per document: key, start in the whole, n_tokens, ids_crc32, and the ids if asked."""
    segments = spark.read.parquet(folder)
    # One number per range of the key that was written.
    totals = segments.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()
    starts, total = {}, 0
    for row in sorted(totals, key=lambda r: r.range):
        starts[row.range] = total
        total += row.n
    schema = f"`{key}` LONG, start LONG, n_tokens LONG, ids_crc32 LONG" + (
        ", ids BINARY" if ids else ""
    )
    shape = arrow_schema(schema)

    def unpack(batch):
        for r, before, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = Segment.unpacked(data)
            ends = found.ends.all()
            lows = np.concatenate(([0], ends[:-1])).astype(np.int64)
            whole = memoryview(found.ids.astype("<u4").tobytes())
            parts = [whole[4 * a : 4 * b] for a, b in zip(lows.tolist(), ends.tolist(), strict=True)]
            if found.keys is None:
                keys = pa.nulls(len(ends), pa.int64())
            else:
                keys = pa.array(found.keys.all() + found.first_key)
            columns = [
                keys,
                pa.array(lows + starts[r] + before),
                pa.array(ends - lows),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            ]
            if ids:
                columns.append(pa.array([bytes(p) for p in parts], pa.binary()))
            yield pa.record_batch(columns, schema=shape)

    return in_arrow(segments.select("range", "before", "segment"), unpack, schema)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id") -> DataFrame:
    """Writes to a new shared folder and reads it back."""
    folder = shared_folder(docs.sparkSession)
    write(docs, tokenizer, end_id, folder, key)
    return read(docs.sparkSession, folder, key)
