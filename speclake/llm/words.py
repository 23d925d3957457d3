"""Words, shingles and their hashes, for whole Arrow columns at once.

A text column is one byte buffer.  Word borders come from a 256-entry table, a
word's hash from running sums over the buffer, and a window's hash from its
words' hashes, so no step loops over words.  Only *candidates* rest on hashes
of 64 bits; operators that promise exact hits compare what lies beneath.

The buffer is read in pieces of ``PIECE`` bytes that end between words, so
memory follows the piece and the number of words, also for a very long text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 21

# Multipliers of the polynomial hashes: odd, so each has an inverse mod 2^64.
_BYTE = 0x9E3779B97F4A7C15
_WORD = 0xC2B2AE3D27D4EB4F
_M64 = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_table(pattern_bytes: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes belong to words: the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in pattern_bytes:
        table[low : high + 1] = True
    return table


# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lower-cased: digits, letters, non-ASCII.
ALNUM = word_table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
# [^\x20\x09-\x0D]+ : all but white space.
SPACED = word_table([(0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF)])


class Words(NamedTuple):
    """Words of several texts: hash, place in the buffer, and text borders."""

    hashes: np.ndarray  # uint64
    starts: np.ndarray  # byte places in ``data``
    ends: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]
    data: np.ndarray  # the bytes, as stored


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of each value over all 64."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... mod 2^64, at least ``n`` of them."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1024), base, dtype=np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if n <= 2 * PIECE:
            _powers[base] = known
    return known


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    places = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    found = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    places = places.astype(np.int64)
    return found[places[0] : places[-1]], places - places[0]


def _piece(data, inside, at, end, lower):
    """Hashes, starts and ends of the words in data[at:end]."""
    mask = inside[at:end]
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    first = np.concatenate(([0], edge)) if len(mask) and mask[0] else edge
    if len(first) % 2:
        first = np.append(first, len(mask))
    starts, ends = first[0::2], first[1::2]
    part = data[at:end]
    if lower:
        part = LOWER[part]
    n = end - at + 1
    sums = np.empty(n, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_BYTE, n)[: n - 1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(pow(_BYTE, -1, 1 << 64), n)[starts]
    return mixed(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(48))), starts + at, ends + at


def words_of(column: pa.Array, table: np.ndarray, lower: bool = False) -> Words:
    """All words of a text column; words never cross from one text to the next."""
    data, offsets = buffer_of(column)
    size = len(data)
    inside = table[data]
    hashes, starts, ends = [], [], []
    # Texts that touch would run together: such borders are cut by position.
    borders = offsets[1:-1]
    at = 0
    while at < size:
        end = min(at + PIECE, size)
        if end < size:
            gap = np.flatnonzero(~inside[at + 1 : end])
            if len(gap):
                end = at + 1 + int(gap[-1]) + 1
            else:  # one word longer than a piece
                while end < size and inside[end]:
                    step = inside[end : end + PIECE]
                    stop = np.flatnonzero(~step)
                    end += int(stop[0]) if len(stop) else len(step)
        h, s, e = _piece(data, inside, at, end, lower)
        # Words that hold a border of texts are hashed again by part.
        if len(s) and len(borders):
            low = np.searchsorted(borders, s, "right")
            high = np.searchsorted(borders, e, "left")
            bad = np.flatnonzero(high > low)
            if len(bad):
                keep = np.ones(len(s), bool)
                keep[bad] = False
                cut_s, cut_e = [], []
                for i in bad:
                    marks = np.unique(borders[low[i] : high[i]])
                    cut = np.concatenate(([s[i]], marks, [e[i]]))
                    cut_s.append(cut[:-1])
                    cut_e.append(cut[1:])
                cs, ce = np.concatenate(cut_s), np.concatenate(cut_e)
                ch = np.concatenate(
                    [_piece(data, inside, int(x), int(y), lower)[0] for x, y in zip(cs, ce, strict=True)]
                )
                s, e = np.concatenate((s[keep], cs)), np.concatenate((e[keep], ce))
                h = np.concatenate((h[keep], ch))
                order = np.argsort(s, kind="stable")
                h, s, e = h[order], s[order], e[order]
        hashes.append(h)
        starts.append(s)
        ends.append(e)
        at = end
    if hashes:
        h, s, e = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
    else:
        h, s, e = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Words(h, s, e, np.searchsorted(s, offsets, "left"), data)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, by doubling; runs may cross texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    whole, width, part, done = None, 1, hashes, 0
    rest = n
    while rest:
        if rest & 1:
            if whole is None:
                whole, done = part, width
            else:  # ``part`` follows what is there
                m = min(len(whole), len(part) - done)
                by = np.uint64(pow(_WORD, width, 1 << 64))
                whole = whole[:m] * by + part[done : done + m]
                done += width
        rest >>= 1
        if rest:
            by = np.uint64(pow(_WORD, width, 1 << 64))
            part = part[: len(part) - width] * by + part[width:]
            width *= 2
    return mixed(whole[: len(hashes) - n + 1] ^ np.uint64(n))


def whole_hashes(words: Words) -> np.ndarray:
    """Hash of each text's whole run of words, equal to a window of that length."""
    out = np.zeros(len(words.bounds) - 1, np.uint64)
    for i, (low, high) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
        if high > low:
            out[i] = window_hashes(words.hashes[low:high], int(high - low))[0]
    return out


def owners(bounds: np.ndarray) -> np.ndarray:
    """Number of the text that each word belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 * PIECE):
    """The batch in parts whose texts have about ``most`` bytes; at least one row each."""
    _, offsets = buffer_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end
