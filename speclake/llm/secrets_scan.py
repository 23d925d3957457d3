"""Secret scan: keywords first, anchored patterns near their hits, then checksums.

An Aho-Corasick automaton finds all keywords of a text in one pass; a pattern
is tried only where its keyword starts.  Kinds whose secrets carry a checksum
or a length of their own are kept only if it holds.  Runs of hexadecimal
digits have no keyword: each byte is mapped to its class, and the keyword is a
run of the class.

Kinds, in this order:

* ``assign``, ``access``, ``hex``: the base kinds, kept as found
* ``github``, ``npm``: tokens that end in the CRC-32 of what comes before
* ``pem``: private keys whose Base64 body decodes to one whole DER sequence
* ``jwt``: tokens whose head decodes to an object that names an algorithm
* ``iban``, ``card``: account and card numbers with a right check number.  All
  lengths that end before a blank, a hyphen or other text are tried; where
  numbers overlap, those of a length that their country or first digits have
  come first, then the leftmost, then the longest

Spans are code points, end exclusive.  Matches of a kind never overlap; but
for account and card numbers, the leftmost counts.

Defined cases: NULL and empty texts have no spans; repeated rows are each
scanned; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speclake.llm import words as W
from speclake.llm.shared import arrow_schema, in_arrow

KINDS = ("assign", "access", "hex", "github", "npm", "pem", "jwt", "iban", "card")

# What the base kinds are.
ASSIGN = re.compile(
    rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
PEM = re.compile(
    rb"-----BEGIN ([A-Z0-9]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1?PRIVATE KEY-----"
)
JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
JWT_RUN = re.compile(rb"eyJ[A-Za-z0-9_-]*")
IBAN = re.compile(rb"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9]){12,18}")
IBAN_GOES_ON, CARD_GOES_ON = re.compile(rb"[A-Za-z0-9]"), re.compile(rb"[0-9]")
LEAST_IBAN, LEAST_CARD = 12, 13
# Lengths by country and by first digits; numbers of other lengths come after them.
IBAN_SIZES = {
    country.encode(): size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
        27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
CARD_SIZES = re.compile(
    rb"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|3[47][0-9]{13}"
    rb"|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}"
    rb"|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}"
    rb"|6(?:011|4[4-9][0-9]|[25][0-9]{2})[0-9]{12,15}|(?:5[06-8]|6[0-9])[0-9]{11,17}"
)
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_holds(token: bytes) -> bool:
    """Whether the last six characters are the CRC-32 of the rest after the prefix."""
    body = token[token.index(b"_") + 1 :]
    value = 0
    for c in body[-6:]:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body[:-6])


def der_holds(match: re.Match) -> bool:
    """Whether the body is one DER sequence of just the length it states."""
    try:
        data = base64.b64decode(b"".join(match[2].split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(data) < 2 or data[0] != 0x30:
        return False
    size, at = data[1], 2
    if size & 0x80:
        n = size & 0x7F
        at, size = 2 + n, int.from_bytes(data[2 : 2 + n])
    return at + size == len(data)


def jwt_holds(token: bytes) -> bool:
    head = token.split(b".")[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(found, dict) and "alg" in found


def iban_holds(text: bytes) -> bool:
    """Remainder 1 by 97, letters counted from 10 on."""
    text = text.replace(b" ", b"")
    moved = text[4:] + text[:4]
    return int("".join(str(int(chr(c), 36)) for c in moved)) % 97 == 1


def luhn_holds(text: bytes) -> bool:
    digits = [c - 48 for c in text if 48 <= c < 58]
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0 and len(set(digits)) > 1


def iban_usual(text: bytes) -> bool:
    return len(text.replace(b" ", b"")) == IBAN_SIZES.get(text[:2])


def card_usual(text: bytes) -> bool:
    return bool(CARD_SIZES.fullmatch(text.translate(None, b" -")))


def numbers(text: bytes, starts, longest, goes_on, least: int, holds, usual) -> list[tuple[int, int]]:
    """Numbers with a right check, none of which overlap."""
    found = []
    for start in starts:
        match = longest.match(text, start)
        size = 0
        for end, c in enumerate(match[0] if match else b"", start + 1):
            size += c not in b" -"
            if size >= least and c not in b" -" and not goes_on.match(text, end):
                if holds(text[start:end]):
                    found.append((not usual(text[start:end]), start, -end))
    out: list[tuple[int, int]] = []
    for _, start, end in sorted(found):
        at = bisect(out, (start, -end))
        if (not at or out[at - 1][1] <= start) and (at == len(out) or -end <= out[at][0]):
            out.insert(at, (start, -end))
    return out


# Keyword, kind, pattern anchored at the keyword, and the check of a match.
RULES = [
    *((w, "assign", ASSIGN, lambda m: len(m[1]) >= LEAST_VALUE) for w in ASSIGN_WORDS),
    ("akia", "access", ACCESS, lambda m: len(m[0]) >= LEAST_ACCESS),
    *((f"gh{c}_", "github", GITHUB, lambda m: crc_holds(m[0])) for c in "pousr"),
    ("npm_", "npm", NPM, lambda m: crc_holds(m[0])),
    ("-----begin ", "pem", PEM, der_holds),
    ("eyj", "jwt", JWT, lambda m: jwt_holds(m[0])),
]
# Kinds that start with a class of bytes: the keyword in the text's classes.
_CLASS = bytearray(b"." * 256)
for _c in b"0123456789":
    _CLASS[_c] = ord("0")
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _CLASS[_c] = ord("A")
_CLASS[ord(" ")] = _CLASS[ord("-")] = ord("-")
CLASSES = bytes(_CLASS)
IBAN_START = re.compile(rb"(?<![A0])AA00(?=-?[A0])")
CARD_START = re.compile(rb"(?<!0)0(?=(?:-?0){12})")
HEX_CLASS = bytes(ord("x") if c in b"0123456789abcdef" else ord(".") for c in range(256))
HEX_RUN = re.compile(rb"x{%d,}" % LEAST_HEX)


def automaton():
    """All keywords; ASCII letters of the text are lower-cased before."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (word, *_) in enumerate(RULES):
        found.add_word(word, (i, len(word)))
    found.make_automaton()
    return found


_automaton = None


def spans_of(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets of a UTF-8 text, in bytes."""
    global _automaton
    _automaton = _automaton or automaton()
    out: list[tuple[int, int, int]] = []
    # One character per byte, so places in both agree.
    for kind, hits in _by_kind(_automaton.iter(text.lower().decode("latin-1"))).items():
        taken = 0
        for start, rule in sorted(hits):
            if start < taken:
                continue
            _, _, pattern, holds = RULES[rule]
            match = pattern.match(text, start)
            if match:
                taken = match.end()
                if holds(match):
                    out.append((start, KINDS.index(kind), match.end()))
            elif pattern is JWT and (run := JWT_RUN.match(text, start)):
                # What follows the run decided, and it is the same for all starts in the run.
                taken = run.end()
    for match in HEX_RUN.finditer(text.translate(HEX_CLASS)):
        out.append((match.start(), KINDS.index("hex"), match.end()))
    classes = text.translate(CLASSES)
    for kind, first, *rule in (
        ("iban", IBAN_START, IBAN, IBAN_GOES_ON, LEAST_IBAN, iban_holds, iban_usual),
        ("card", CARD_START, CARD, CARD_GOES_ON, LEAST_CARD, luhn_holds, card_usual),
    ):
        starts = (hit.start() for hit in first.finditer(classes))
        out.extend((s, KINDS.index(kind), e) for s, e in numbers(text, starts, *rule))
    return sorted(out)


def _by_kind(hits) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {}
    for last, (rule, n) in hits:
        found.setdefault(RULES[rule][1], []).append((last - n + 1, rule))
    return found


def _code_points(text: bytes, places: np.ndarray) -> np.ndarray:
    """Code points before each byte place."""
    starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(starts)))[places]


SPANS = "spans ARRAY<STRUCT<kind: STRING, start: LONG, end: LONG>>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its spans, by start and then kind."""
    held = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([held.schema[0], *T._parse_datatype_string(SPANS).fields])
    shape = arrow_schema(schema)

    def step(batch):
        for some in W.slices(batch, "_text"):
            rows = []
            data, offsets = W.buffer_of(some.column(1))
            for low, high in zip(offsets[:-1], offsets[1:], strict=True):
                text = data[low:high].tobytes()
                found = spans_of(text)
                if found:
                    places = np.array([(s, e) for s, _, e in found])
                    points = places if text.isascii() else _code_points(text, places)
                    rows.append(
                        [
                            {"kind": KINDS[k], "start": s, "end": e}
                            for (_, k, _), (s, e) in zip(found, points.tolist(), strict=True)
                        ]
                    )
                else:
                    rows.append([])
            yield pa.record_batch([some.column(0), pa.array(rows, shape.field(1).type)], schema=shape)

    return in_arrow(held, step, schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds and the spans as text."""

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count(kind: str):
        return (
            F.size(F.filter("spans", lambda s: s["kind"] == kind))
            .cast("long")
            .alias(f"n_{kind}")
        )

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        key,
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
