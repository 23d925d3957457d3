"""SentencePiece encoding and decoding for merge-type vocabularies.

A piece of text is cut into characters.  An agenda holds every adjacent pair
of symbols whose union is a piece of the vocabulary, best score first, the
leftmost first among equals; pairs are merged until the agenda is empty.
Characters that are no piece become their bytes.

In these vocabularies no piece has a blank after another character, so merges
never cross from one word to the next: words are encoded alone, and the ids of
words met lately are kept.
The vocabulary is checked for that, and otherwise texts are encoded whole.
Words not met before are encoded together: the agendas of all of them are the
rows of one array, and each round merges every word's best pair.  Words of more
than ``LONG`` characters take an agenda of their own.

Each Arrow batch is checked against the library's own ids, each word that its
texts hold once; ``agrees`` tells the outcome for every text, and a text with a
word that differs gets the library's ids.

Defined cases: NULL and empty texts have only the begin and end ids and decode
to an empty text; repeated rows are each encoded; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speclake.llm import words as W
from speclake.llm.shared import Kept, arrow_schema, in_arrow

BLANK = "▁"
KEPT = 500_000  # words of each of two generations
LONG = 48
_NONE = np.int32(2**31 - 1)  # no such pair


class Pieces:
    """A merge-type vocabulary."""

    def __init__(self, model: str | bytes):
        import sentencepiece

        if isinstance(model, bytes):
            self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        else:
            self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        sp = self.library
        size = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused pieces are not handled")
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids: dict[int, int] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.pieces[piece] = (i, sp.get_score(i))
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        by_word = all(BLANK not in p.lstrip(BLANK) for p in self.pieces)
        self.by_word = by_word
        self.find = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+" if by_word else r"(?s).+").findall
        self.known = Kept(KEPT)
        self._index()

    def _index(self) -> None:
        """Symbols by character, and unions by pair, for many words at once.

        A symbol is a piece's id, or the first number past the ids plus the
        character's code for a character that is no piece.
        """
        self.size = self.library.get_piece_size()
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.size
        for piece, (i, _) in self.pieces.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        scores = sorted({s for _, s in self.pieces.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}  # equal scores, equal rank
        pairs = {}
        for piece, (i, score) in self.pieces.items():
            for cut in range(1, len(piece)):
                left, right = self._symbol(piece[:cut]), self._symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (i, place[score])
        self.slots = 1 << 20
        self.slot_key = np.full(self.slots, -1, np.int64)
        self.slot_union = np.zeros(self.slots, np.int64)
        self.slot_rank = np.full(self.slots, _NONE, np.int32)
        self.steps = 1
        for (left, right), (union, rank) in pairs.items():
            key = (left << 32) | right
            slot, step = self._slot(key), 1
            while self.slot_key[slot] != -1:
                slot, step = (slot + 1) % self.slots, step + 1
            self.slot_key[slot], self.slot_union[slot], self.slot_rank[slot] = key, union, rank
            self.steps = max(self.steps, step)

    def _symbol(self, text: str) -> int | None:
        if text in self.pieces:
            return self.pieces[text][0]
        return self.size + ord(text) if len(text) == 1 else None

    def _slot(self, key):
        if isinstance(key, int):
            return ((key * 0x9E3779B97F4A7C15) & W._M64) >> 44
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(
            np.int64
        )

    def _offers(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and union of every pair; rank ``_NONE`` where there is none."""
        key = (left << 32) | right
        slot = self._slot(key)
        rank, union = np.full(len(key), _NONE), np.zeros(len(key), np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.steps):
            at = slot[todo]
            held = self.slot_key[at]
            hit = held == key[todo]
            rank[todo[hit]] = self.slot_rank[at[hit]]
            union[todo[hit]] = self.slot_union[at[hit]]
            todo = todo[~hit & (held != -1)]
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) % self.slots
        return rank, union

    def merged_together(self, words: list[str]) -> list[bytes]:
        """Ids of many words, as bytes."""
        if len(words) > 50_000:
            return self.merged_together(words[:50_000]) + self.merged_together(words[50_000:])
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 20), (20, LONG)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(rows):
                self._merge_rows([words[i] for i in rows], lengths[rows], rows, out)
        for i in np.flatnonzero(lengths > LONG):
            out[i] = np.array(self.merged(words[i]), "<u4").tobytes()
        return out

    def _merge_rows(self, words, lengths, rows, out) -> None:
        wide = int(lengths.max())
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        table = np.full((len(words), wide), -1, np.int64)
        table[np.arange(wide) < lengths[:, None]] = self.of_char[codes]
        rank, union = np.full((len(words), 0), _NONE), np.zeros((len(words), 0), np.int64)
        if wide > 1:
            flat = self._offers(table[:, :-1].ravel(), table[:, 1:].ravel())
            rank, union = (x.reshape(len(words), wide - 1) for x in flat)
        while True:
            n, wide = table.shape
            if wide > 1:
                best = rank.argmin(axis=1)  # the leftmost of the best
                line = np.arange(n)
                goes_on = rank[line, best] < _NONE
            else:
                goes_on = np.zeros(n, bool)
            done = ~goes_on
            if done.any():
                self._put(table[done], rows[done], out)
            if not goes_on.any():
                return
            table, rank, union = table[goes_on], rank[goes_on], union[goes_on]
            rows, best = rows[goes_on], best[goes_on]
            n = len(rows)
            line = np.arange(n)
            table[line, best] = union[line, best]
            stays = np.ones((n, wide), bool)
            stays[line, best + 1] = False
            table = table[stays].reshape(n, wide - 1)
            stays = np.ones((n, wide - 1), bool)
            stays[line, best] = False
            rank = rank[stays].reshape(n, wide - 2)
            union = union[stays].reshape(n, wide - 2)
            for near in (best - 1, best):  # the pairs on both sides of the union
                some = np.flatnonzero((near >= 0) & (near < wide - 2))
                at = near[some]
                rank[some, at], union[some, at] = self._offers(
                    table[some, at], table[some, at + 1]
                )

    def _put(self, table, rows, out) -> None:
        """Symbols of finished words as ids; characters that are no piece as bytes."""
        odd = (table >= self.size).any(axis=1)
        plain = np.flatnonzero(~odd)
        if len(plain):
            some = table[plain]
            stays = some >= 0
            ends = (4 * np.cumsum(stays.sum(axis=1))).tolist()
            data, at = some[stays].astype("<u4").tobytes(), 0
            for row, end in zip(rows[plain].tolist(), ends, strict=True):
                out[row] = data[at:end]
                at = end
        for k in np.flatnonzero(odd):
            ids: list[int] = []
            for s in table[k].tolist():
                if s >= self.size:
                    code = chr(s - self.size).encode()
                    ids.extend([self.byte_ids[b] for b in code] if self.byte_ids else [self.unknown])
                elif s >= 0:
                    ids.append(s)
            out[int(rows[k])] = np.array(ids, "<u4").tobytes()

    def merged(self, text: str) -> list[int]:
        """Ids of a text in which blanks are already marked."""
        symbols: list[str] = list(text)
        last = len(symbols) - 1
        before, after = list(range(-1, last)), list(range(1, last + 2))
        agenda: list[tuple[float, int, int, int]] = []
        pieces = self.pieces

        def offer(left: int, right: int) -> None:
            if left < 0 or right > last:
                return
            union = symbols[left] + symbols[right]
            found = pieces.get(union)
            if found:
                heapq.heappush(agenda, (-found[1], left, right, len(union)))

        for i in range(last):
            offer(i, i + 1)
        while agenda:
            _, left, right, n = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != n:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = a + b, ""
            after[left] = after[right]
            if after[right] <= last:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        ids: list[int] = []
        for s in symbols:
            if s:
                found = pieces.get(s)
                if found:
                    ids.append(found[0])
                elif self.byte_ids:
                    ids.extend(self.byte_ids[b] for b in s.encode())
                else:
                    ids.append(self.unknown)
        return ids

    def cut(self, text: str | None) -> list[str]:
        """A text's words, each with the blanks before it marked."""
        if not text:
            return []
        odd = BLANK in text or "  " in text or "\0" in text or text[0] == " " or text[-1] == " "
        if self.by_word and not odd:  # single blanks only: no pattern is needed
            return (BLANK + text.replace(" ", "\0" + BLANK)).split("\0")
        return self.find(BLANK + text.replace(" ", BLANK))

    def encoded(self, texts: list[str | None], check: bool = False) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of texts, each with begin and end, and whether they are the library's.

        A text's ids are those of its words one after the other, in the library
        as here.  So every word that the texts hold is compared, once for all
        texts; a text with one that differs gets the library's ids.
        """
        cut = [self.cut(t) for t in texts]
        distinct = set().union(*cut)
        known = self.known.of(distinct, self.merged_together)
        wrong = self.differing(list(distinct), known) if check else set()
        out, agrees = [], []
        for text, words in zip(texts, cut, strict=True):
            agrees.append(wrong.isdisjoint(words))
            if not agrees[-1]:
                whole = self.library.encode(text, add_bos=True, add_eos=True)
                out.append(np.array(whole, "<u4"))
                continue
            body = b"".join([known[w] for w in words])
            ids = np.empty(len(body) // 4 + 2, "<u4")
            ids[0], ids[-1] = self.begin, self.end
            ids[1:-1] = np.frombuffer(body, "<u4")
            out.append(ids)
        return out, agrees

    def differing(self, words: list[str], known: dict[str, bytes]) -> set[str]:
        """Words whose ids are not the library's."""
        # The library marks a text's start with a blank itself, but no empty text's:
        # words of blanks only are looked at behind another one.
        before = self.library.encode("a")
        other = self.library.encode(
            [w[1:].replace(BLANK, " ") if w.strip(BLANK) else "a" + " " * len(w) for w in words], num_threads=1
        )
        other = [ids if w.strip(BLANK) else ids[len(before) :] for w, ids in zip(words, other, strict=True)]
        sizes = np.fromiter(map(len, other), np.int64, len(other))
        ids = np.fromiter(chain.from_iterable(other), "<u4", int(sizes.sum()))
        own = [known[w] for w in words]
        if b"".join(own) == ids.tobytes() and all(len(a) == 4 * b for a, b in zip(own, sizes.tolist(), strict=True)):
            return set()
        return {w for w, a, b in zip(words, own, other, strict=True) if a != np.array(b, "<u4").tobytes()}


_loaded: dict[str, Pieces] = {}


def loaded(model: str) -> Pieces:
    """The vocabulary of a model file, read once per worker."""
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


OUT = "n_tokens LONG, ids BINARY, decoded STRING, agrees BOOLEAN"
DIGEST = "n_tokens LONG, ids_sha256 STRING, decoded_sha256 STRING, agrees BOOLEAN"


def encode(
    docs: DataFrame,
    model: str,
    key: str = "doc_id",
    text: str = "text",
    digests: bool = False,
    check: bool = True,
) -> DataFrame:
    """Per document: ids as little-endian unsigned 32-bit integers, and the decoded text.

    With ``digests``, hashes of both instead, so that neither leaves the task.
    ``check`` compares all words of a batch with the library's ids, which are
    returned where they differ (``agrees`` is false there); without it ``agrees``
    is NULL.
    """
    held = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    own = T._parse_datatype_string(DIGEST if digests else OUT)
    schema = T.StructType([held.schema[0], *own.fields])
    shape = arrow_schema(schema)

    def step(batch):
        vocabulary = loaded(model)
        for some in W.slices(batch, "_text", W.PIECE // 2):
            texts = some.column(1).to_pylist()
            ids, agrees = vocabulary.encoded(texts, check)
            decoded = vocabulary.library.decode([i.tolist() for i in ids])
            agrees = agrees if check else [None] * len(ids)
            if digests:
                first = [hashlib.sha256(i).hexdigest() for i in ids]
                second = [hashlib.sha256(d.encode()).hexdigest() for d in decoded]
            else:
                first, second = [i.tobytes() for i in ids], decoded
            yield pa.record_batch(
                [
                    some.column(0),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array(first, shape.field(2).type),
                    pa.array(second, shape.field(3).type),
                    pa.array(agrees, pa.bool_()),
                ],
                schema=shape,
            )

    return in_arrow(held, step, schema)
