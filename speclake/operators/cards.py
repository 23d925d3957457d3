"""Cards of a product list, found where pages are read.

``variants.variant_records`` looks for cards and their fields on the tree of a page,
as a Column.  Here the same selectors are tried in the parse, and only what a
card holds is handed over: texts cleaned as by ``text.clean_text``, attributes as
they stand in the page.  Whole pages are read, and a card is any element its
selector takes.

Pages are taken apart in batches: places of tags and texts as arrays, tags by
their form.  Pages of one shape (``parse._Shapes``) whose tags meet the same
steps have their cards and fields at the same places, so selectors are tried
once per shape and a page's own texts and values are put in.  Any other page is
read by its tree.
"""

from __future__ import annotations

import gc
import re
import sys
from bisect import bisect_left
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from speclake.functions.text import _MARKS
from speclake.operators.parse import (
    _NUMBERS,
    _OUTPUT_CHARS,
    _REFERENCE,
    _SHAPE_PARTS,
    _referenced,
    _Shape,
    _Shapes,
    _Tree,
    decode_escaped,
    read_tree,
)
from speclake.operators.selectors import as_data

# Executors get this module with the job, installed there or not.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Attributes that fields are read from; all others are texts.
FROM_ATTRIBUTE = {"url": "href", "image": "src"}
CARD_FIELDS = (
    "title", "item_reference", "ref", "url", "description", "image",
    "list_price", "your_price", "availability",
)
CARDS = "ARRAY<STRUCT<" + ", ".join(f"{name}: STRING" for name in CARD_FIELDS) + (
    ", specs: ARRAY<STRUCT<key: STRING, value: STRING>>>>"
)
_OWN, _FIELDS = CARD_FIELDS.index("your_price"), len(CARD_FIELDS)
# Fixed value: characters of all cards of a batch; pages with more are read in smaller batches.
_MOST_CHARS = 16 * _OUTPUT_CHARS

# The references that most texts hold no others of; "&amp;" is last, as it gives none of these.
_COMMON = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&"))

# ``text.clean_text`` in Python, and the bytes that a text must hold for it to change
# anything but blanks: white space, and what begins white space, escapes and comments.
_MARK = re.compile(_MARKS)
_UNCLEAN = np.zeros(256, bool)
_UNCLEAN[[*range(9, 14), *range(28, 32), *b"\\<", 0xC2, 0xE1, 0xE2, 0xE3]] = True

# A chain's steps: number of what one element must be like, its place among siblings
# of its name, and whether it is a child of the step before.
Chain = list[tuple[int, int | None, bool]]


class Nodes(NamedTuple):
    """What selectors read of a tree, by start order."""

    parent: list[int]
    last: list[int]
    nth: list[int]
    marks: list[int]


class Found(NamedTuple):
    """A card's elements; -1 where there is none."""

    card: int
    fields: list[int]
    specs: list[tuple[int, int]]


class Rule:
    """The selectors of a product list, as plain data.

    Its steps come as ``selectors.as_data`` gives them, which workers need not have.
    """

    def __init__(self, container: list | None, cards: list | None, fields: Mapping[str, list | None],
                 specs: list[list | None] | None) -> None:
        self.steps: list[tuple] = []
        self.container = self._chains(container)
        self.cards = self._chains(cards)
        self.fields = [self._chains(fields.get(name)) for name in CARD_FIELDS]
        self.specs = specs and [self._chains(selector) for selector in specs]
        self.marked = frozenset(name for step in self.steps for name, op, _ in step[3] if op)
        if any(step[1] is not None for step in self.steps):
            self.marked |= {"id"}

    def _chains(self, selector: list | None) -> list[Chain]:
        return [[(self._number(step[:5]), *step[5:]) for step in chain] for chain in selector or ()]

    def _number(self, step: tuple) -> int:
        if step not in self.steps:
            self.steps.append(step)
        return self.steps.index(step)

    # -- selection --------------------------------------------------------
    def mark(self, tag: str, attrs: Mapping[str, str], classes: list[str]) -> int:
        """The steps an element meets, as bits; its place among others is left out."""
        met = 0
        for i, (name, own_id, having, tests, without) in enumerate(self.steps):
            if (
                (not name or name == tag)
                and (own_id is None or attrs.get("id") == own_id)
                and all(c in classes for c in having)
                and not any(c in classes for c in without)
                and all(_attribute(attrs.get(a), op, value) for a, op, value in tests)
            ):
                met |= 1 << i
        return met

    def holds(self, nodes: Nodes, at: int, chains: list[Chain]) -> bool:
        parent, _, nth, marks = nodes

        def met(here: int, step: tuple[int, int | None, bool]) -> bool:
            return bool(marks[here] >> step[0] & 1) and (step[1] is None or nth[here] == step[1])

        for chain in chains:
            if not met(at, chain[-1]):
                continue
            if len(chain) == 1:
                return True
            # Outer steps, as bits, that any element further up may meet, or only the next one.
            bit = 1 << (len(chain) - 2)
            far, near = (0, bit) if chain[-1][2] else (bit, 0)
            here = parent[at]
            while here >= 0:
                open_now, near = far | near, 0
                for i in range(len(chain) - 1):
                    if open_now >> i & 1 and met(here, chain[i]):
                        if i == 0:
                            return True
                        if chain[i][2]:
                            near |= 1 << (i - 1)
                        else:
                            far |= 1 << (i - 1)
                here = parent[here]
        return False

    def all(self, nodes: Nodes, chains: list[Chain]) -> list[int]:
        """The elements of a page that a selector takes; which card they are in makes no difference."""
        return [at for at, mark in enumerate(nodes.marks) if mark and self.holds(nodes, at, chains)]

    def found(self, nodes: Nodes) -> list[Found]:
        """The cards of a page in page order."""
        size = len(nodes.parent)
        box = _first(self.all(nodes, self.container), 0, size)
        scope = (0, size) if box < 0 else (box + 1, nodes.last[box] + 1)
        cards = _between(self.all(nodes, self.cards), *scope)
        if not cards:
            return []
        fields = [self.all(nodes, rule) for rule in self.fields]
        rows, keys, values = [self.all(nodes, rule) for rule in self.specs] if self.specs else ([], [], [])
        out = []
        for card in cards:
            below = card + 1, nodes.last[card] + 1
            specs = []
            for row in _between(rows, *below):
                inner = row + 1, nodes.last[row] + 1
                specs.append((_first(keys, *inner), _first(values, *inner)))
            out.append(Found(card, [_first(taken, *below) for taken in fields], specs))
        return out

    def found_inside(self, nodes: Nodes) -> list[Found]:
        """What a template of its own gives: one card, of which only the own price is read."""
        fields = [-1] * _FIELDS
        fields[_OWN] = _first(self.all(nodes, self.fields[_OWN]), 0, len(nodes.parent))
        return [Found(-1, fields, [])]


def _between(elements: list[int], start: int, end: int) -> list[int]:
    return elements[bisect_left(elements, start) : bisect_left(elements, end)]


def _first(elements: list[int], start: int, end: int) -> int:
    at = bisect_left(elements, start)
    return elements[at] if at < len(elements) and elements[at] < end else -1


def _attribute(held: str | None, op: str, value: str) -> bool:
    if held is None or op == "":
        return held is not None
    if op == "=":
        return held == value
    if not value:
        return False
    return value in held if op == "*=" else held.startswith(value) if op == "^=" else held.endswith(value)


class _Plan(NamedTuple):
    """Where the cells of a page's cards lie: fields card by card, then labels and values of specs.

    A cell is one text, one value, or texts to be joined; others are NULL.
    """

    cells: int
    cards: int
    spec_counts: np.ndarray  # rows of specs, by card
    texts: np.ndarray  # cells, and their parts of the page
    values: np.ndarray  # cells, their tags, and places among the tag's values
    joined: np.ndarray  # cells of several texts or none
    join_parts: np.ndarray
    join_counts: np.ndarray
    templates: list[tuple[int, list[int]]]  # parts that may hold markup as text, and the cells they may fill


def _cells(found: list[Found]) -> Iterator[tuple[int, int, str | None]]:
    """(cell, element, attribute) of all that was found."""
    for i, card in enumerate(found):
        for j, element in enumerate(card.fields):
            if element >= 0:
                yield i * _FIELDS + j, element, FROM_ATTRIBUTE.get(CARD_FIELDS[j])
    at = len(found) * _FIELDS
    for card in found:
        for pair in card.specs:
            for element in pair:
                if element >= 0:
                    yield at, element, None
                at += 1


def _size(found: list[Found]) -> int:
    return len(found) * _FIELDS + 2 * sum(len(card.specs) for card in found)


def _fills(found: list[Found], owner: int, last: list[int]) -> list[int]:
    """Cells of own prices that a template may fill: of cards around it that have none."""
    return [
        i * _FIELDS + _OWN
        for i, card in enumerate(found)
        if card.fields[_OWN] < 0 and card.card < owner <= (last[card.card] if card.card >= 0 else -1)
    ]


def _plan(shape: _Shape, find: Callable[[Nodes], list[Found]]) -> _Plan:
    numbers = dict(zip(_NUMBERS, shape.numbers.tolist(), strict=False))
    found = find(Nodes(numbers["parent"], numbers["last"], numbers["nth"], shape.marks))
    texts, values, joined = [], [], []
    for cell, element, attribute in _cells(found):
        if attribute is None:
            parts = [at for at, _ in shape.texts[numbers["t0"][element] : numbers["t1"][element]]]
            if len(parts) == 1:
                texts.append((cell, 2 * parts[0]))
            else:
                joined.append((cell, [2 * at for at in parts]))
        elif attribute in shape.names[element]:
            values.append((cell, shape.starts[element], shape.names[element].index(attribute)))
    return _Plan(
        _size(found),
        len(found),
        np.array([len(card.specs) for card in found], np.int64),
        np.array(texts, np.int64).reshape(-1, 2).T,
        np.array(values, np.int64).reshape(-1, 3).T,
        np.array([cell for cell, _ in joined], np.int64),
        np.array([at for _, parts in joined for at in parts], np.int64),
        np.array([len(parts) for _, parts in joined], np.int64),
        [(2 * at, _fills(found, owner, numbers["last"])) for owner, at in shape.templates],
    )


class _Cells(NamedTuple):
    """Cells of pages whose cards lie alike: places in a pool of texts, -1 for NULL."""

    pages: np.ndarray
    places: np.ndarray  # [page, cell]
    cards: int
    spec_counts: np.ndarray


class TooLarge(Exception):
    """Cards of a batch hold too much text for one batch, as cards inside others repeat it."""


class CardReader:
    """Pages to what their cards hold."""

    def __init__(self, rule: Rule, find: Callable[[Nodes], list[Found]] | None = None) -> None:
        self.rule = rule
        self.find = find or rule.found
        # Templates that hold markup as text are pages of their own.
        self.inside = CardReader(rule, rule.found_inside) if find is None else None
        self.shapes = _Shapes(rule.mark, rule.marked)
        self.plans: dict[bytes, _Plan | None] = {}

    def read(self, column: pa.StringArray) -> tuple[pa.ListArray, set[int]]:
        """Cards by page, and the pages that cannot be read; ``TooLarge`` if there is more than one page."""
        if self.shapes.make_room():
            self.plans.clear()
        count = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: count + 1]
        data = column.buffers()[2] or pa.py_buffer(b"")
        chars = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]

        # A tag reaches from a "<" to the next ">", with no other "<" between.
        opens = np.flatnonzero(chars == ord("<")) + offsets[0]
        closes = np.append(np.flatnonzero(chars == ord(">")) + offsets[0], offsets[-1])
        page = np.searchsorted(offsets, opens, "right") - 1
        ends = closes[np.searchsorted(closes, opens)]
        regular = np.ones(count, bool)
        regular[page[ends >= np.minimum(np.append(opens[1:], offsets[-1]), offsets[page + 1])]] = False
        tags = np.bincount(page, minlength=count)
        regular &= (tags > 0) & (tags < _SHAPE_PARTS)
        kept = regular[page]
        opens, ends, page = opens[kept], ends[kept], page[kept]

        # The pages' parts: text, tag, text, ... text; one part where a page is not regular.
        tags = np.where(regular, tags, 0)
        first_tag = np.cumsum(tags) - tags
        base = np.append(0, np.cumsum(2 * tags + 1))
        total = int(base[-1])
        at = base[page] + 2 * (np.arange(len(page)) - first_tag[page]) + 1
        cuts = np.empty(total + 1, np.int32)
        cuts[base[:-1]], cuts[-1] = offsets[:-1], offsets[-1]
        cuts[at], cuts[at + 1] = opens, ends + 1
        parts = pa.StringArray.from_buffers(total, pa.py_buffer(cuts), data)

        # Tags by their form.
        met = parts.take(pa.array(at)).dictionary_encode()
        infos = [self._tag(text[1:-1]) for text in _strings(met.dictionary)]
        code = met.indices.to_numpy()
        forms = np.array([-1 if info is None else info[0] for info in infos], np.int64)[code]
        regular[page[forms < 0]] = False
        value_lists = [() if info is None else info[1] for info in infos]
        value_counts = np.array([len(values) for values in value_lists], np.int64)

        # Texts with references are decoded.
        where = np.arange(total)
        decoded: list[str] = []
        is_tag = np.zeros(total, bool)
        is_tag[at] = True
        marked = np.searchsorted(cuts, np.flatnonzero(chars == ord("&")) + offsets[0], "right") - 1
        marked = marked[np.diff(marked, prepend=-1) > 0]
        owners = np.searchsorted(base, marked, "right") - 1
        chosen = ~is_tag[marked] & regular[owners]
        marked, owners = marked[chosen], owners[chosen]
        for part, owner, text in zip(
            marked.tolist(), owners.tolist(), _strings(parts.take(pa.array(marked))), strict=True
        ):
            text = _decoded(text)
            if text is None:
                regular[owner] = False
            else:
                where[part] = total + len(decoded)
                decoded.append(text)

        first_value = total + len(decoded) + np.cumsum(value_counts) - value_counts
        values = [value for values in value_lists for value in values]
        extra_base = total + len(decoded) + len(values)
        extra: list[str] = []
        joins: list[np.ndarray] = []
        join_counts: list[np.ndarray] = []
        joined = 0
        cells: list[_Cells] = []
        bad: set[int] = set()
        # A template gives one text at most.
        most = _MOST_CHARS if count > 1 and self.inside else None
        inner: list[tuple[int, np.ndarray, int, list[int]]] = []
        inner_texts: list[str] = []

        # Pages of one shape together.
        sequence = (np.diff(cuts) > 0).astype(np.int32)
        sequence[at] = forms
        keys, starts = sequence.tobytes(), (4 * base).tolist()
        groups: dict[bytes, list[int]] = {}
        odd = np.flatnonzero(~regular).tolist()
        for i in np.flatnonzero(regular).tolist():
            groups.setdefault(keys[starts[i] : starts[i + 1]], []).append(i)
        for key, members in groups.items():
            plan = self._plan_of(key)
            if plan is None:
                odd += members
                continue
            if not plan.cards:
                continue
            pages = np.array(members)
            start = base[pages][:, None]
            places = np.full((len(pages), plan.cells), -1, np.int64)
            places[:, plan.texts[0]] = where[start + plan.texts[1]]
            cell, tag, place = plan.values
            places[:, cell] = first_value[code[first_tag[pages][:, None] + tag]] + place if len(cell) else -1
            if len(plan.joined):
                size = len(pages) * len(plan.joined)
                # Texts to be joined lie behind all others, whose number is not known yet.
                places[:, plan.joined] = -2 - joined - np.arange(size).reshape(len(pages), -1)
                joins.append(where[start + plan.join_parts].ravel())
                join_counts.append(np.tile(plan.join_counts, len(pages)))
                joined += size
            if self.inside:
                for part, fills in plan.templates:
                    held = where[base[pages] + part] - total
                    for row in np.flatnonzero(held >= 0).tolist():
                        text = decoded[held[row]]
                        if "<" in text:
                            inner.append((members[row], places, row, fills))
                            inner_texts.append(text)
            cells.append(_Cells(pages, places, plan.cards, plan.spec_counts))

        odd_chars = 0
        for i in odd:
            try:
                found, texts, last, held = self._by_tree(column[i].as_py())
            except Exception:  # one bad page must not end the job
                bad.add(i)
                continue
            odd_chars += sum(len(text) for _, text in texts)
            if most and odd_chars > most:
                raise TooLarge
            places = np.full((1, _size(found)), -1, np.int64)
            for cell, text in texts:
                places[0, cell] = extra_base + len(extra)
                extra.append(text)
            for owner, text in held:
                inner.append((i, places, 0, _fills(found, owner, last)))
                inner_texts.append(text)
            counts = np.array([len(card.specs) for card in found], np.int64)
            cells.append(_Cells(np.array([i]), places, len(found), counts))

        if inner:
            prices, unread = self.inside._prices(inner_texts)
            for number, ((i, places, row, fills), price) in enumerate(zip(inner, prices, strict=True)):
                if number in unread:
                    bad.add(i)
                elif price is not None:
                    for cell in fills:
                        if places[row, cell] == -1:  # the first template that has one
                            places[row, cell] = extra_base + len(extra)
                            extra.append(price)

        pool = pa.concat_arrays(
            [parts, *[pa.array(texts, pa.string()) for texts in (decoded, values, extra)]]
        )
        if joined:
            counts = np.append(0, np.cumsum(np.concatenate(join_counts))).astype(np.int32)
            several = np.concatenate(joins)
            if most and _lengths(pool)[several].sum() > most:
                raise TooLarge
            lists = pa.ListArray.from_arrays(pa.array(counts), pool.take(pa.array(several)))
            behind = len(pool)
            pool = pa.concat_arrays([pool, pc.binary_join(lists, " ")])
        else:
            behind = 0
        return _listed(cells, pool, behind, count, bad, most), bad

    def parts(self, column: pa.StringArray, start: int = 0) -> Iterator[tuple[int, pa.ListArray]]:
        """Cards by page, in parts of the batch that are not too large, each with its first page."""
        try:
            found, _ = self.read(column)
        except TooLarge:
            half = len(column) // 2
            yield from self.parts(column[:half], start)
            yield from self.parts(column[half:], start + half)
        else:
            yield start, found

    def _prices(self, texts: list[str]) -> tuple[list[str | None], set[int]]:
        cards, bad = self.read(pa.array(texts, pa.string()))
        found: list[str | None] = [None] * len(texts)
        prices = _strings(cards.flatten().field(_OWN))
        for price, i in zip(prices, cards.value_parent_indices().to_numpy().tolist(), strict=True):
            found[i] = price
        return found, bad

    def _tag(self, text: str) -> tuple | None:
        try:
            return self.shapes.tag(text)
        except Exception:  # the tree tells what is wrong
            return None

    def _plan_of(self, key: bytes) -> _Plan | None:
        if key in self.plans:
            return self.plans[key]
        sequence = np.frombuffer(key, np.int32).tolist()
        try:
            shape = self.shapes._shape(tuple(sequence[1::2]), tuple([bool(n) for n in sequence[::2]]))
        except Exception:  # the tree tells what is wrong
            shape = None
        self.shapes.parts += len(sequence)
        plan = self.plans[key] = None if shape is None else _plan(shape, self.find)
        return plan

    def _by_tree(self, page: str) -> tuple[list[Found], list, list[int], list]:
        tree: _Tree = read_tree(page)
        nodes = Nodes(
            [n[2] for n in tree.nodes], [n[1] for n in tree.nodes], [n[7] for n in tree.nodes],
            [self.rule.mark(n[4], n[5], n[6]) for n in tree.nodes],
        )
        found = self.find(nodes)
        texts = []
        for cell, element, attribute in _cells(found):
            node = tree.nodes[element]
            if attribute is None:
                texts.append((cell, " ".join(tree.texts[node[8] : node[9]])))
            elif attribute in node[5]:
                texts.append((cell, node[5][attribute]))
        return found, texts, nodes.last, list(tree.text_templates()) if self.inside and found else []


def _decoded(text: str) -> str | None:
    """A text with its references put in; None if that takes an HTML reader."""
    marks = text.count("&")
    plain, left = text, marks
    for reference, char in _COMMON:
        if found := plain.count(reference):
            left -= found
            plain = plain.replace(reference, char)
    if left == 0:
        return plain
    try:
        text, known = _REFERENCE.subn(_referenced, text)
    except Exception:  # the tree tells what is wrong
        return None
    return text if known == marks else None


def clean_text(text: str) -> str:
    if "\\" in text or "<!--" in text:
        text = _MARK.sub(" ", text)
    return " ".join(text.split())


def _strings(texts: pa.StringArray) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _cleaned(texts: pa.StringArray) -> pa.StringArray:
    """``clean_text`` of all texts; only those that it may change are looked at one by one."""
    if not len(texts):
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]
    chars = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    blank = chars == ord(" ")
    odd = _UNCLEAN[chars]
    odd[1:] |= blank[1:] & blank[:-1]
    filled = np.flatnonzero(starts[1:] > starts[:-1])
    unclean = np.zeros(len(texts), bool)
    unclean[filled] = blank[starts[filled]] | blank[starts[filled + 1] - 1]
    unclean[np.searchsorted(starts, np.flatnonzero(odd), "right") - 1] = True
    chosen = np.flatnonzero(unclean)
    if not len(chosen):
        return texts
    fresh = [clean_text(text) for text in _strings(texts.take(pa.array(chosen)))]
    at = np.arange(len(texts))
    at[chosen] = len(texts) + np.arange(len(chosen))
    return pa.concat_arrays([texts, pa.array(fresh, pa.string())]).take(pa.array(at))


def _lengths(texts: pa.StringArray) -> np.ndarray:
    return np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]).astype(np.int64)


def _listed(
    cells: list[_Cells], pool: pa.StringArray, behind: int, count: int, bad: set[int], most: int | None
) -> pa.ListArray:
    """Cards that hold anything, by page."""
    none = np.zeros(0, np.int64)
    pages = np.concatenate([none, *[np.repeat(c.pages, c.cards) for c in cells]])
    places = np.concatenate(
        [none.reshape(0, _FIELDS), *[c.places[:, : c.cards * _FIELDS].reshape(-1, _FIELDS) for c in cells]]
    )
    spec_counts = np.concatenate([none, *[np.tile(c.spec_counts, len(c.pages)) for c in cells]])
    specs = np.concatenate([none.reshape(0, 2), *[c.places[:, c.cards * _FIELDS :].reshape(-1, 2) for c in cells]])

    chosen = np.flatnonzero(((places != -1).any(axis=1) | (spec_counts > 0)) & ~np.isin(pages, [*bad]))
    chosen = chosen[np.argsort(pages[chosen], kind="stable")]
    places = np.where(places < -1, behind - 2 - places, places)[chosen]
    specs = np.where(specs < -1, behind - 2 - specs, specs)
    lengths = _lengths(pool)
    if most and lengths[places[places >= 0]].sum() + lengths[specs[specs >= 0]].sum() > most:
        raise TooLarge

    def texts(at: np.ndarray) -> list[pa.StringArray]:
        """Clean texts of all columns."""
        held = at >= 0
        clean = _cleaned(pool.take(pa.array(at[held])))
        back = np.cumsum(held).reshape(at.shape) - 1
        return [
            clean.take(pa.array(back[:, i], mask=~held[:, i])) if held[:, i].any()
            else pa.nulls(len(at), pa.string())
            for i in range(at.shape[1])
        ]

    is_text = np.array([name not in FROM_ATTRIBUTE for name in CARD_FIELDS])
    clean = iter(texts(places[:, is_text]))
    columns: list[pa.Array] = [
        next(clean) if is_text[i] else pool.take(pa.array(places[:, i], mask=places[:, i] < 0))
        for i in range(_FIELDS)
    ]
    pair = pa.struct([("key", pa.string()), ("value", pa.string())])
    if len(specs):
        pairs = pa.StructArray.from_arrays(texts(specs), fields=[*pair])
        offsets = np.append(0, np.cumsum(spec_counts)).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pairs).take(pa.array(chosen)))
    else:
        columns.append(pa.nulls(len(chosen), pa.list_(pair)))
    cards = pa.StructArray.from_arrays(columns, names=[*CARD_FIELDS, "specs"])
    ends = np.append(0, np.cumsum(np.bincount(pages[chosen], minlength=count))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), cards)


def read_rule(
    container: str = "body", variant_selector: str = "", fields: Mapping | None = None
) -> Rule:
    """Of the configuration of ``variants.variant_records``."""
    fields = dict(fields or {})
    if "item_reference" in fields:  # rules out the short reference
        fields.pop("ref", None)
    specs = fields.pop("specs", None)
    return Rule(
        as_data(container), as_data(variant_selector), {name: as_data(rule) for name, rule in fields.items()},
        specs and [as_data(specs[name]) for name in ("rows", "key", "value")],
    )


def read_cards(pages: DataFrame, html: str, config: Mapping, escape_window: int) -> DataFrame:
    """``parse.parse_pages`` with ``cards``."""
    rule = read_rule(**{n: config[n] for n in ("container", "variant_selector", "fields") if n in config})
    kept = [field for field in pages.schema.fields if field.name != html]
    names = [field.name for field in kept]
    schema = T.StructType([*kept, *T.StructType.fromDDL(f"cards {CARDS}").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = CardReader(rule)
        collecting = gc.isenabled()
        gc.disable()  # as in ``parse_pages``
        try:
            for batch in gathered(batches):
                yield from cards(batch, reader)
        finally:
            if collecting:
                gc.enable()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small batches are read together, as every one costs some steps of its own.
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= _OUTPUT_CHARS:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)

    def cards(batch: pa.RecordBatch, reader: CardReader) -> Iterator[pa.RecordBatch]:
        texts = batch.column(batch.schema.get_field_index(html)).cast(pa.string())
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        # A large batch is read in parts, as places of its tags and texts take room.
        part = (np.cumsum(sizes, dtype=np.int64) - sizes) // _OUTPUT_CHARS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for start, end in zip(edges, edges[1:], strict=False):
            if start == end:
                continue
            own = texts.slice(start, end - start)
            if own.null_count:
                own = own.fill_null("")
            if escape_window:
                own = pa.array([_unescaped(page, escape_window) for page in own.to_pylist()], pa.string())
            other = [batch.column(batch.schema.get_field_index(n)).slice(start, end - start) for n in names]
            for at, found in reader.parts(own):
                kept = [values.slice(at, len(found)) for values in other]
                yield pa.RecordBatch.from_arrays([*kept, found], names=schema.names)

    return pages.select(*names, html).mapInArrow(read, schema)


def _unescaped(page: str, window: int) -> str:
    try:
        return decode_escaped(page, window)
    except Exception:  # a page that cannot be read has no cards
        return ""
