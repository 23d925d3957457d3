"""Elements that are open where a piece of a document begins.

A document may come in pieces that are cut anywhere between its tags, so an
element that one piece opens is closed in a later one, or never.  What a piece
does to the open elements is a *word*: end tags without a start in the piece, and
start tags without an end, in their order.  Words can be joined (an end takes the
nearest start of its name, and all that is open inside), so each document is cut
into ranges that are folded side by side; what crosses a range border is one word
per range.  A word is as long as the piece has unpaired tags, not as its text.

A range is folded in a group of at most ``WIDTH`` words, and the words of a
document's ranges in one; texts take no part in it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from speclake.operators.parse import _KEPT_CHARS, _KEPT_TAGS, _REGULAR, _TAGS, VOID_TAGS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 4096
# Attribute of start tags that are repeated in later pieces: where the element was opened.
MARK = "speclake-opened"
# Elements that end with their piece, as markup in them is text.
TEXT_TAGS = frozenset("script style textarea title".split())

# Elements whose content an HTML reader may take as text.
_RAW_TAGS = TEXT_TAGS | frozenset("iframe noembed noframes noscript plaintext xmp".split())

_NAME = re.compile(r"<([^\s/>]+)")


class Word:
    """Unpaired tags in their order: ``/tag`` ends, and start tags as they are written.

    ``whole``: the word begins where the document does, so ends without a start
    are of no effect.
    """

    def __init__(self, tokens: Iterable[str] = (), whole: bool = False):
        self.tokens: list[str] = []
        self._whole = whole
        self._names: list[str] = []  # of the starts after the last end
        self._open: dict[str, int] = {}
        self.extend(tokens)

    def start(self, name: str, text: str) -> None:
        self.tokens.append(text)
        self._names.append(name)
        self._open[name] = self._open.get(name, 0) + 1

    def end(self, name: str) -> None:
        if self._open.get(name):
            closed = None
            while closed != name:
                closed = self._names.pop()
                self._open[closed] -= 1
                self.tokens.pop()
        elif not self._whole:
            # It may close an element of an earlier piece, and all starts before it then.
            self.tokens.append("/" + name)
            self._names, self._open = [], {}

    def extend(self, tokens: Iterable[str]) -> None:
        for token in tokens:
            if token[0] == "/":
                self.end(token[1:])
            else:
                self.start(_NAME.match(token)[1], token)


class _Reader(HTMLParser):
    def __init__(self, number: int):
        super().__init__(convert_charrefs=False)
        self.word = Word()
        self._number = number
        self._count = 0

    def handle_starttag(self, tag, attrs):
        if tag not in VOID_TAGS:
            rest = (self.get_starttag_text() or "")[1 + len(tag) :]
            self.word.start(tag, f'<{tag} {MARK}="{self._number}:{self._count}"{rest}')
        self._count += 1

    def handle_startendtag(self, tag, attrs):
        self._count += 1

    def handle_endtag(self, tag):
        self.word.end(tag)


class _Tags(dict):
    """Tags met lately, by their text: kind, name and what follows the name; None for irregular ones."""

    def __missing__(self, text: str) -> tuple[str, str, str] | None:
        if len(self) > _KEPT_TAGS:
            self.clear()
        found = _REGULAR.fullmatch(f"<{text}>")
        kept = None
        if found is not None:
            end, tag, attrs, empty, _ = found.groups()
            name = (tag or "").lower()
            if tag is None:
                kept = ("!", "", "")
            elif end:
                kept = None if attrs or empty or name in _RAW_TAGS else ("/", name, "")
            elif name not in _RAW_TAGS:
                kept = ("br" if empty or name in VOID_TAGS else "p", name, text[len(tag) :])
        if len(text) <= _KEPT_CHARS:
            self[text] = kept
        return kept


def _regular_word(html: str, number: int, tags: _Tags) -> list[str] | None:
    """The word of a piece of regular markup; None for any other."""
    found = [tags[text] for text in _TAGS.findall(html)]
    if None in found or html.count("<") != len(found):
        return None
    word, count = Word(), 0
    for kind, name, rest in found:
        if kind == "/":
            word.end(name)
        elif kind != "!":
            if kind == "p":
                word.start(name, f'<{name} {MARK}="{number}:{count}"{rest}>')
            count += 1
    return word.tokens


def word_of(html: str | None, number: int, tags: _Tags | None = None) -> list[str]:
    """The word of one piece; ``tags`` keeps what its tags are from piece to piece."""
    if tags is not None and (regular := _regular_word(html or "", number, tags)) is not None:
        return regular
    reader = _Reader(number)
    reader.feed(html or "")
    reader.close()
    return [t for t in reader.word.tokens if t[0] == "/" or _NAME.match(t)[1] not in TEXT_TAGS]


def _fields(rows: DataFrame, names: Sequence[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*(T.StructField(n, rows.schema[n].dataType) for n in names), *more])


_WORD = T.StructField("word", T.ArrayType(T.StringType()))


def _words(pieces: DataFrame, keys: Sequence[str], order: str, html: str) -> DataFrame:
    names = [*keys, order]
    schema = _fields(pieces, names, _WORD)
    shape = to_arrow_schema(schema)

    def read(batches):
        tags = _Tags()
        for batch in batches:
            numbers, texts = batch.column(len(names) - 1), batch.column(len(names))
            words = [word_of(t.as_py(), n.as_py(), tags) for n, t in zip(numbers, texts, strict=True)]
            yield pa.record_batch(
                [*batch.columns[: len(names)], pa.array(words, pa.list_(pa.string()))], schema=shape
            )

    return pieces.where(F.col(order).isNotNull()).select(*names, html).mapInArrow(read, schema)


def _folded(rows: DataFrame, by: Sequence[str], order: str, whole: bool) -> DataFrame:
    """Per row the word of all rows before it in its group; the word of the whole group, in a row without order."""
    schema = _fields(rows, [*by, order], T.StructField("before", _WORD.dataType))
    shape = to_arrow_schema(schema)
    names = [*by, order]

    def fold(batches):
        group, word = None, Word(whole=whole)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

        for batch in batches:
            out = []
            *keys, orders, words = (column.to_pylist() for column in batch.columns)
            for *own, place, tokens in zip(*keys, orders, words, strict=True):
                if group is None or not all(a == b or a != a and b != b for a, b in zip(group, own, strict=True)):
                    if group is not None:
                        out.append((*group, None, word.tokens))
                    group, word = own, Word(whole=whole)
                out.append((*own, place, list(word.tokens)))
                word.extend(tokens)
            if out:
                yield made(out)
        if group is not None:
            yield made([(*group, None, word.tokens)])

    # A group's rows lie together, in their order: there are many small groups.
    dealt = rows.select(*names, "word").repartition(*by).sortWithinPartitions(*by, order)
    return dealt.mapInArrow(fold, schema)


def _equal(left: Sequence[str], right: Sequence[str]) -> Column:
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return same


def opened_before(
    pieces: DataFrame, keys: Sequence[str], order: str, html: str, stage, width: int = WIDTH
) -> DataFrame:
    """Keys, order and ``opened`` of the pieces that begin inside of elements.

    ``opened`` are the start tags of these elements, the outermost first, with the
    attribute ``MARK``: the number of the piece that has them and their place in it.
    ``order`` is a whole number, unique within a document; ``stage`` keeps rows that
    two steps read.
    """
    words = _words(pieces, keys, order, html).withColumn("_range", F.floor(F.col(order) / F.lit(width)))
    folded = stage(_folded(words, [*keys, "_range"], order, whole=False))
    totals = folded.where(F.col(order).isNull()).select(*keys, "_range", F.col("before").alias("word"))
    borders = _folded(totals, keys, "_range", whole=True).where(F.col("_range").isNotNull())
    names = [*keys, "_range"]
    renamed = borders.select(*[F.col(n).alias(f"_b_{n}") for n in names], F.col("before").alias("_border"))
    inside = folded.where(F.col(order).isNotNull()).join(
        renamed.hint("merge"), _equal(names, [f"_b_{n}" for n in names])
    )
    rows = inside.where((F.size("before") > 0) | (F.size("_border") > 0)).select(
        *keys, order, "_border", "before"
    )
    schema = _fields(rows, [*keys, order], T.StructField("opened", _WORD.dataType))
    shape = to_arrow_schema(schema)

    def apply(batches):
        for batch in batches:
            kept = batch.columns[:-2]
            opened = []
            for border, before in zip(batch.column(len(kept)), batch.column(len(kept) + 1), strict=True):
                word = Word(border.as_py(), whole=True)
                word.extend(before.as_py())
                opened.append(word.tokens)
            yield pa.record_batch([*kept, pa.array(opened, pa.list_(pa.string()))], schema=shape)

    return rows.mapInArrow(apply, schema).where(F.size("opened") > 0)


def with_open_elements(
    pieces: DataFrame, keys: Sequence[str], order: str, html: str, stage, width: int = WIDTH
) -> DataFrame:
    """The pieces, each within the elements that are open where it begins; ``_opened`` is their number.

    Pieces are joined with their own elements, so no document's pieces meet in one task.
    """
    names = [*keys, order]
    opened = opened_before(pieces, keys, order, html, stage, width)
    renamed = opened.select(*[F.col(n).alias(f"_o_{n}") for n in names], F.col("opened").alias("_tags"))
    joined = pieces.join(renamed.hint("merge"), _equal(names, [f"_o_{n}" for n in names]), "left")
    within = F.concat(F.array_join("_tags", ""), F.coalesce(html, F.lit("")))
    return joined.withColumns({
        html: F.when(F.col("_tags").isNotNull(), within).otherwise(F.col(html)),
        "_opened": F.coalesce(F.size("_tags"), F.lit(0)),
    }).select(*pieces.columns, "_opened")
