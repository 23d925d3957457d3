"""Pages to page trees: the one place where a Python worker is needed.

A page row becomes one row that holds the page tree as arrays, in document
order:

* ``nodes[i]`` is the element with start order ``i``; its descendants are
  exactly ``nodes[i + 1 .. nodes[i].last]``, so "inside" is an array slice and
  never a join;
* ``nodes[i].heads`` headings start before the element, so its section is one
  lookup in the list of headings;
* ``texts`` are the plain text runs; an element owns ``texts[t0 .. t1 - 1]``;
* ``ink[j] - ink[i]`` characters other than white space, at the least, remain
  of ``texts[i .. j - 1]`` when it is cleaned: elements with too much text for a
  pattern are told without putting their text together;
* ``scripts`` are the script bodies;
* ``template_nodes`` / ``template_texts`` hold the trees of templates whose
  only content is text (``owner`` is the template element);
* ``spans``, on demand, are the places of the elements in the page text.

Everything after this step is Spark SQL expressions on that row, so a page is
never shuffled.  The work of one task is one input row at a time.
"""

from __future__ import annotations

import gc
import html as html_entities
import re
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from html.entities import html5
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Executors get this module with the job, installed there or not.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_FIELDS = (
    "pre INT, last INT, parent INT, depth INT, tag STRING, "
    "attrs MAP<STRING, STRING>, classes ARRAY<STRING>, nth INT, t0 INT, t1 INT, heads INT"
)
TREE_FIELDS = (
    f"nodes ARRAY<STRUCT<{NODE_FIELDS}>>, "
    "texts ARRAY<STRING>, "
    "ink ARRAY<INT>, "
    "scripts ARRAY<STRUCT<pre INT, type STRING, body STRING>>, "
    f"template_nodes ARRAY<STRUCT<owner INT, {NODE_FIELDS}>>, "
    "template_texts ARRAY<STRING>, "
    "source STRING, error STRING"
)

# Elements without content, elements whose text is not page
# text, and elements in which white space is kept.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input "
    "isindex keygen link menuitem meta nextid param source spacer track wbr".split()
)
UNREAD_TAGS = frozenset("script style template rt rp".split())
SPACED_TAGS = frozenset("pre textarea".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())

SPAN_FIELD = (
    "spans ARRAY<STRUCT<start: INT, inner: INT, inner_end: INT, end: INT>>"
)

# Markup that every HTML reader takes the same way.  Most pages hold nothing
# else and are read by this one pattern; all others go through HTMLParser.
_REGULAR = re.compile(
    r"""<(?:(/)?([a-zA-Z][a-zA-Z0-9:_.\-]*)                 # end, tag
          ((?:\s+[a-zA-Z_:@][^\s"'<>/=]*                    # attributes
             (?:=(?:"[^"]*"|'[^']*'|[^\s"'<>=`]+))?)*)\s*(/?)>   # empty
         |!--(?!-?>)[^-]*(?:-[^-]+)*-->
         |!(?:DOCTYPE|doctype)[^>]*>)
      |([^<]+)                                             # text""",
    re.VERBOSE,
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+)))?""")
_REFERENCE = re.compile(
    r"&(?:#([0-9]+|[xX][0-9a-fA-F]+);|([a-zA-Z][a-zA-Z0-9]*);|(?![a-zA-Z#]))"
)
_RAW_END = {
    tag: re.compile(rf"</(?P<space>\s*){tag}(?P<close>\s*>)?", re.IGNORECASE)
    for tag in ("script", "style")
}

_NO_ATTRS: dict[str, str] = {}
_NO_CLASSES: list[str] = []
_ASCII_SPACES = " \n\t\f\r"
# The escapes of a page that was stored as a string literal.
_ESCAPE = re.compile(
    r"""\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([0-7]{1,3})
         |([\\'"abfnrtv\n]))""",
    re.VERBOSE,
)
_SHORT_ESCAPES = {
    "\\": "\\", "'": "'", '"': '"', "a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r",
    "t": "\t", "v": "\v", "\n": "",
}
# Fixed value: how far into a page it is looked for signs of being escaped.
ESCAPE_WINDOW = 1000
_OUTPUT_CHARS = 4_000_000

def _unescaped(match: re.Match) -> str:
    two, four, eight, octal, short = match.groups()
    if short:
        return _SHORT_ESCAPES[short]
    code = int(octal, 8) if octal else int(two or four or eight, 16)
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return "\N{REPLACEMENT CHARACTER}"
    return chr(code)


def decode_escaped(page: str, window: int = ESCAPE_WINDOW) -> str:
    """Undo the two ways in which a whole page is found escaped.

    The first ``window`` characters decide; 0 takes pages as they are.  Escapes
    are decoded one by one, so characters that are not escaped are left as they
    are.
    """
    head = page[:window]
    if "\\x3C" in head or "\\x3E" in head:
        return _ESCAPE.sub(_unescaped, page)
    if "&lt;" in head:
        return html_entities.unescape(page)
    return page


def _numbered(number: str) -> str:
    code = int(number[1:], 16) if number[0] in "xX" else int(number)
    if 0x80 <= code <= 0x9F:
        return bytes([code]).decode("cp1252", errors="ignore") or chr(code)
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return "\N{REPLACEMENT CHARACTER}"
    return chr(code)


def _named(name: str) -> str:
    return html5.get(f"{name};", f"&{name}")


def _referenced(match: re.Match) -> str:
    number, name = match.groups()
    return _numbered(number) if number else _named(name) if name else "&"


class _Tree(HTMLParser):
    """Collects one document as flat node, text and script lists."""

    def __init__(self, page: str | None = None) -> None:
        """``page``: the text to be fed, if element places are wanted."""
        super().__init__(convert_charrefs=False)
        self.spans: list[list[int]] = []
        self._page = page
        self._lines = [0]
        if page is not None:
            self._lines += [m.end() for m in re.finditer("\n", page)]
        self.nodes: list[list] = []
        self.texts: list[str] = []
        self.scripts: list[tuple[int, str | None, str]] = []
        self._open: list[int] = []
        self._open_tags: dict[str, int] = {}
        self._unread: list[int] = []
        self._spaced = 0
        self._heads = 0
        self._run: list[str] = []
        self._sibling_counts: list[dict[str, int]] = [{}]
        self._body: dict[int, list[str]] = {}
        # Children of templates and of what is inside them: an int is an
        # element, a str is a text or a comment.
        self._inside_template: dict[int, list[int | str]] = {}

    # -- elements ---------------------------------------------------------
    def _start(self, tag: str, attrs: list) -> None:
        self._flush()
        pre = len(self.nodes)
        parent = self._open[-1] if self._open else -1
        counts = self._sibling_counts[-1]
        nth = counts[tag] = counts.get(tag, 0) + 1
        values = {name: value or "" for name, value in attrs} if attrs else _NO_ATTRS
        classes = values["class"].split() if "class" in values else _NO_CLASSES
        here = len(self.texts)
        self.nodes.append(
            [pre, pre, parent, len(self._open), tag, values, classes, nth, here, here,
             self._heads]
        )
        if tag in HEADING_TAGS:
            self._heads += 1
        if parent in self._inside_template:
            self._inside_template[parent].append(pre)
            self._inside_template[pre] = []
        elif tag == "template":
            self._inside_template[pre] = []
        if self._page is not None:
            start = self._place()
            inner = start + len(self.get_starttag_text() or "")
            self.spans.append([start, inner, inner, inner])
        self._open.append(pre)
        self._open_tags[tag] = self._open_tags.get(tag, 0) + 1
        self._sibling_counts.append({})
        if tag in UNREAD_TAGS:
            self._unread.append(pre)
            if tag == "script":
                self._body[pre] = []
        if tag in SPACED_TAGS:
            self._spaced += 1

    def _close_top(self) -> None:
        pre = self._open.pop()
        self._sibling_counts.pop()
        node = self.nodes[pre]
        tag = node[4]
        node[1] = len(self.nodes) - 1
        node[9] = len(self.texts)
        self._open_tags[tag] -= 1
        if self._unread and self._unread[-1] == pre:
            self._unread.pop()
        if tag in SPACED_TAGS:
            self._spaced -= 1
        if tag == "script":
            self.scripts.append((pre, node[5].get("type"), "".join(self._body.pop(pre))))

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs)
        if tag in VOID_TAGS:
            self._close_top()

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs)
        self._close_top()

    def handle_endtag(self, tag):
        self._flush()
        if not self._open_tags.get(tag):
            return
        closed = None
        while closed != tag:
            top = self._open[-1]
            closed = self.nodes[top][4]
            self._close_top()
            if self._page is not None:
                here = self._place()
                after = here
                if closed == tag:
                    after = self._page.find(">", here) + 1 or len(self._page)
                self.spans[top][2:] = [here, after]

    def _place(self) -> int:
        line, column = self.getpos()
        return self._lines[line - 1] + column

    # -- text -------------------------------------------------------------
    def handle_data(self, data):
        self._run.append(data)

    def handle_charref(self, name):
        self._run.append(_numbered(name))

    def handle_entityref(self, name):
        self._run.append(_named(name))

    def handle_comment(self, data):
        self._flush()
        if self._open and self._open[-1] in self._inside_template:
            self._inside_template[self._open[-1]].append(data)

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self._run.append(data[6:])
            self._flush()

    def _flush(self) -> None:
        if not self._run:
            return
        run = "".join(self._run)
        self._run.clear()
        if not self._spaced and not run.strip(_ASCII_SPACES):
            run = "\n" if "\n" in run else " "
        if self._open and self._open[-1] in self._inside_template:
            self._inside_template[self._open[-1]].append(run)
        if not self._unread:
            self.texts.append(run)
        elif self.nodes[self._unread[-1]][4] == "script":
            self._body[self._unread[-1]].append(run)

    def read_regular(self, page: str) -> bool:
        """Reads a page of regular markup; False, half read, at anything else."""
        at, size = 0, len(page)
        match_at = _REGULAR.match
        while at < size:
            found = match_at(page, at)
            if found is None:
                return False
            at = found.end()
            end, tag, attrs, empty, text = found.groups()
            if text is not None:
                if "&" in text:
                    marks = text.count("&")
                    text, known = _REFERENCE.subn(_referenced, text)
                    if known != marks:
                        return False
                self._run.append(text)
            elif tag is None:
                if page.startswith("<!--", found.start()):
                    self.handle_comment(page[found.start() + 4 : at - 3])
                else:
                    self._flush()
            elif end:
                if attrs or empty:
                    return False
                self.handle_endtag(tag.lower())
            else:
                tag = tag.lower()
                pairs = []
                if attrs:
                    for name, double, one, bare in _ATTR.findall(attrs):
                        value = double or one or bare
                        if "&" in value:
                            value = html_entities.unescape(value)
                        pairs.append((name.lower(), value))
                self._start(tag, pairs)
                if empty or tag in VOID_TAGS:
                    self._close_top()
                elif tag in _RAW_END:
                    close = _RAW_END[tag].search(page, at)
                    if close is None or close["space"] or not close["close"]:
                        return False
                    if close.start() > at:
                        self._run.append(page[at : close.start()])
                    self.handle_endtag(tag)
                    at = close.end()
        self._close_all(size)
        return True

    def finish(self) -> None:
        self.close()
        self._close_all(len(self._page or ""))

    def _close_all(self, size: int) -> None:
        self._flush()
        while self._open:
            if self._page is not None:
                self.spans[self._open[-1]][2:] = [size, size]
            self._close_top()

    def text_templates(self) -> Iterator[tuple[int, str]]:
        """Templates that hold one text and nothing else, with that text."""
        for pre, children in self._inside_template.items():
            if self.nodes[pre][4] != "template":
                continue
            while len(children) == 1 and isinstance(children[0], int):
                children = self._inside_template[children[0]]
            if len(children) == 1 and "<" in children[0]:
                yield pre, children[0]


def read_tree(page: str, positions: bool = False) -> _Tree:
    if not positions:
        tree = _Tree()
        if tree.read_regular(page):
            return tree
    tree = _Tree(page if positions else None)
    tree.feed(page)
    tree.finish()
    return tree


# A page of regular markup falls into texts and tags here; a text with "<" is none.
_TAGS = re.compile(r"<([^<>]*)>")
# What a worker keeps of the tags and shapes it has met.
_KEPT_TAGS, _KEPT_CHARS, _KEPT_PARTS, _SHAPE_PARTS = 1 << 15, 512, 1 << 18, 1 << 12
_NUMBERS = ("pre", "last", "parent", "depth", "nth", "t0", "t1", "heads")


class _Shape(NamedTuple):
    """What pages with the same tags, attribute names and places of texts have in common."""

    numbers: np.ndarray  # [number, node]: ``_NUMBERS``, then counts of attributes and classes
    tags: list[str]
    attr_names: list[str]
    held: list[int]  # tags of the page that have attributes
    texts: list[tuple[int, bool]]  # texts of the page that are read, and whether all white space is kept
    templates: list[tuple[int, int]]  # template elements that hold one text only, and that text
    starts: list[int]  # tag of the page that starts each element
    names: list[tuple[str, ...]]  # attribute names of each element
    marks: list[int]  # what ``_Shapes.mark`` says of each element


class _Read(NamedTuple):
    """One page by its shape."""

    shape: _Shape
    values: list[str]
    classes: list[str]
    texts: list[str]
    inner: list[tuple[int, str]]  # templates that hold markup as text


class _Shapes(dict):
    """Tags met lately, by their text: number of the form, attribute values, classes.

    Pages of a site are alike, so the tree of a shape is built once (by ``_Tree``)
    and a page's own texts and values are put in.

    ``mark``: a number that tag, attributes and classes give; pages whose marks
    differ are of different shapes.  It reads the values of ``marked`` attributes
    and of the class only.
    """

    def __init__(self, mark: Callable[..., int] | None = None, marked: frozenset[str] = frozenset()) -> None:
        super().__init__()
        self.mark = mark
        self.marked = marked | {"class"}
        # What tags have in common that differ in quoted values only.
        self.frames: dict[tuple[str, ...], tuple] = {}
        self.forms: dict[tuple, int] = {}
        self.by_number: list[tuple] = []
        self.shapes: dict[tuple, _Shape | None] = {}
        self.parts = 0

    def __missing__(self, tag: str) -> tuple | None:
        found = self._tag(tag)
        if len(tag) <= _KEPT_CHARS:
            self[tag] = found
        return found

    def tag(self, text: str) -> tuple | None:
        """As ``self[text]``, without keeping a tag that has values of its own."""
        found = self.get(text)
        if found is not None:
            return found
        pieces = text.split('"')
        if len(pieces) < 3 or "&" in text:
            return self[text]
        frame = self.frames.get(tuple(pieces[::2]))
        if frame is None:
            return self._framed(text, pieces)
        slots, told, known = frame
        form = known.get(tuple([pieces[at] for at in told]))
        if form is None:
            return self._framed(text, pieces)
        return form[0], tuple([pieces[at] for at in slots]), form[1]

    def _framed(self, text: str, pieces: list[str]) -> tuple | None:
        """Reads a tag and keeps its frame: what lies between double quotes is a value, whatever it holds."""
        found = self._tag(text)
        outer = tuple(pieces[::2])
        if found is None or len(pieces) % 2 == 0 or text[0] in "!/" or any("'" in piece for piece in outer):
            return found
        frame = self.frames.get(outer)
        if frame is None:
            # A value that is not quoted holds no blank.
            signs = [f"v {i}" for i in range(len(pieces) // 2)]
            whole = "".join([f'{piece}"{sign}"' for piece, sign in zip(outer, signs, strict=False)])
            attrs = _REGULAR.fullmatch(f"<{whole}{outer[-1]}>")[3]
            read = _ATTR.findall(attrs)
            names = [name.lower() for name, *_ in read]
            if [double for _, double, *_ in read] != signs or len(set(names)) < len(names):
                return found
            if len(self.frames) > _KEPT_TAGS:
                self.frames.clear()
            slots = [2 * i + 1 for i in range(len(signs))]
            told = [at for at, name in zip(slots, names, strict=True) if name in self.marked]
            frame = self.frames[outer] = slots, told, {}
        known = frame[2]
        if len(known) > _KEPT_CHARS:
            known.clear()
        known[tuple([pieces[at] for at in frame[1]])] = found[0], found[2]
        return found

    def _tag(self, text: str) -> tuple | None:
        found = _REGULAR.fullmatch(f"<{text}>")
        if found is None:
            return None
        end, tag, attrs, empty, _ = found.groups()
        values, classes = _NO_ATTRS, _NO_CLASSES
        if tag is None:
            form = ("!--",) if text.startswith("!--") else ("!",)
        elif end:
            if attrs or empty:
                return None
            form = ("/", tag.lower())
        else:
            tag = tag.lower()
            if tag in _RAW_END:
                return None
            if attrs:
                values = {}
                for name, double, one, bare in _ATTR.findall(attrs):
                    value = double or one or bare
                    values[name.lower()] = html_entities.unescape(value) if "&" in value else value
                classes = values["class"].split() if "class" in values else _NO_CLASSES
            mark = self.mark(tag, values, classes) if self.mark else 0
            form = ("", tag, tuple(values), len(classes), bool(empty) or tag in VOID_TAGS, mark)
        number = self.forms.get(form)
        if number is None:
            number = self.forms[form] = len(self.by_number)
            self.by_number.append(form)
        return number, tuple(values.values()), classes

    def make_room(self) -> bool:
        """Whether all forms and shapes were forgotten, as there were too many."""
        if self.parts > _KEPT_PARTS or len(self.by_number) > _KEPT_TAGS:
            self.clear()
            self.__init__(self.mark, self.marked)
            return True
        if len(self) > _KEPT_TAGS:
            self.clear()
        return False

    def read(self, page: str) -> _Read | None:
        """A page of regular markup with tags, without scripts and styles; None for any other."""
        parts = _TAGS.split(page)
        if not 1 < len(parts) <= 2 * _SHAPE_PARTS:
            return None
        self.make_room()
        tags = [self[tag] for tag in parts[1::2]]
        if None in tags:
            return None
        texts = parts[::2]
        key = (tuple([tag[0] for tag in tags]), tuple([text != "" for text in texts]))
        if key in self.shapes:
            shape = self.shapes[key]
        else:
            shape = self.shapes[key] = self._shape(*key)
            self.parts += len(parts)
        if shape is None:
            return None
        # A text with a "<" is no text: there is markup that was not taken for a tag.
        if page.count("<") != len(tags):
            return None
        if "&" in page:
            for at, text in enumerate(texts):
                if "&" in text:
                    marks = text.count("&")
                    texts[at], known = _REFERENCE.subn(_referenced, text)
                    if known != marks:
                        return None
        values: list[str] = []
        classes: list[str] = []
        for at in shape.held:
            _, own, names = tags[at]
            values += own
            if names:
                classes += names
        read = []
        for at, spaced in shape.texts:
            run = texts[at]
            if not spaced and not run.strip(_ASCII_SPACES):
                run = "\n" if "\n" in run else " "
            read.append(run)
        inner = [(owner, texts[at]) for owner, at in shape.templates if "<" in texts[at]]
        return _Read(shape, values, classes, read, inner)

    def _shape(self, numbers: tuple[int, ...], filled: tuple[bool, ...]) -> _Shape | None:
        """The tree of a page of which only its tags' forms and the places of its texts are known."""
        tree = _Tree()
        starts, spaced = [], {}
        forms = [self.by_number[n] for n in numbers]
        for at, text in enumerate(filled):
            if text:
                spaced[at] = bool(tree._spaced)
                tree.handle_data(str(at))
            if at == len(forms):
                break
            kind, *form = forms[at]
            if kind == "/":
                tree.handle_endtag(form[0])
            elif kind == "":
                starts.append(at)
                tree._start(form[0], [])
                if form[3]:
                    tree._close_top()
            else:
                if kind == "!--" and tree._open and tree._open[-1] in tree._inside_template:
                    return None  # comments count among a template's children
                tree._flush()
        tree._close_all(0)
        templates = []
        for pre, children in tree._inside_template.items():
            if tree.nodes[pre][4] == "template":
                while len(children) == 1 and isinstance(children[0], int):
                    children = tree._inside_template[children[0]]
                if len(children) == 1:
                    templates.append((pre, int(children[0])))
        own = [forms[at] for at in starts]
        rows = [
            [n[0], n[1], n[2], n[3], n[7], n[8], n[9], n[10], len(form[2]), form[3]]
            for n, form in zip(tree.nodes, own, strict=True)
        ]
        return _Shape(
            np.array(rows, np.int32).reshape(-1, len(_NUMBERS) + 2).T,
            [n[4] for n in tree.nodes],
            [name for form in own for name in form[2]],
            [at for at, form in zip(starts, own, strict=True) if form[2]],
            [(int(at), spaced[int(at)]) for at in tree.texts],
            templates,
            starts,
            [form[2] for form in own],
            [form[5] for form in own],
        )


def read_page(page: str, shapes: _Shapes) -> _Read | _Tree:
    """The page by its shape, or else its tree."""
    try:
        found = shapes.read(page)
    except Exception:  # the tree tells what is wrong
        found = None
    return read_tree(page) if found is None else found


def ink_counts(texts: list[str]) -> list[int]:
    """Running lower bound of the characters that cleaning leaves.

    Cleaning takes out white space, escapes with a backslash and comments.  A
    comment may reach over several runs, so a page with one counts nothing.
    """
    if any("<!--" in text for text in texts):
        return [0] * (len(texts) + 1)
    total, counts = 0, [0]
    for text in texts:
        if "\\" not in text:
            total += len("".join(text.split()))
        counts.append(total)
    return counts


class _NodeColumns:
    """Column lists for one output batch of node arrays."""

    def __init__(self, with_owner: bool = False) -> None:
        self.numbers: list[np.ndarray] = [np.zeros((len(_NUMBERS) + 2, 0), np.int32)]
        self.tags: list[str] = []
        self.owners: list[int] | None = [] if with_owner else None
        self.attr_names: list[str] = []
        self.attr_values: list[str] = []
        self.class_values: list[str] = []
        self.ends = [0]

    def add(self, found: _Read | _Tree, owner: int = -1, shift: int = 0) -> None:
        if isinstance(found, _Read):
            shape = found.shape
            numbers = shape.numbers
            self.tags += shape.tags
            self.attr_names += shape.attr_names
            self.attr_values += found.values
            self.class_values += found.classes
        elif found.nodes:
            pre, last, parent, depth, tag, attrs, classes, nth, t0, t1, heads = zip(*found.nodes)
            counts = (list(map(len, attrs)), list(map(len, classes)))
            numbers = np.array((pre, last, parent, depth, nth, t0, t1, heads, *counts), np.int32)
            self.tags += tag
            for values in attrs:
                if values:
                    self.attr_names += values.keys()
                    self.attr_values += values.values()
            for tokens in classes:
                if tokens:
                    self.class_values += tokens
        else:
            return
        if shift:
            numbers = numbers.copy()
            numbers[_NUMBERS.index("t0") : _NUMBERS.index("t1") + 1] += shift
        self.numbers.append(numbers)
        if self.owners is not None:
            self.owners += [owner] * numbers.shape[1]

    def end_page(self) -> None:
        self.ends.append(len(self.tags))

    def array(self) -> pa.ListArray:
        *plain, attr_counts, class_counts = np.concatenate(self.numbers, axis=1)
        attrs = pa.MapArray.from_arrays(
            _ends(attr_counts), pa.array(self.attr_names, pa.string()), pa.array(self.attr_values, pa.string())
        )
        classes = pa.ListArray.from_arrays(_ends(class_counts), pa.array(self.class_values, pa.string()))
        numbers = {name: pa.array(values) for name, values in zip(_NUMBERS, plain, strict=True)}
        fields = {
            "pre": numbers["pre"], "last": numbers["last"], "parent": numbers["parent"],
            "depth": numbers["depth"], "tag": pa.array(self.tags, pa.string()), "attrs": attrs,
            "classes": classes, "nth": numbers["nth"], "t0": numbers["t0"],
            "t1": numbers["t1"], "heads": numbers["heads"],
        }
        if self.owners is not None:
            fields = {"owner": pa.array(self.owners, pa.int32()), **fields}
        nodes = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), nodes)


def _ends(counts: np.ndarray) -> pa.Array:
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.array(ends)


def _lists(lists: list[list], kind: pa.DataType) -> pa.ListArray:
    flat = [value for values in lists for value in values]
    return pa.ListArray.from_arrays(_ends(np.array([len(v) for v in lists], np.int32)), pa.array(flat, kind))


class _PageColumns:
    """Column lists for one output batch of parsed pages."""

    def __init__(
        self,
        shapes: _Shapes,
        positions: bool = False,
        window: int = ESCAPE_WINDOW,
        counts_ink: bool = True,
    ) -> None:
        self.shapes = shapes
        self.window = window
        self.counts_ink = counts_ink
        self.spans: list[list[dict]] | None = [] if positions else None
        self.nodes = _NodeColumns()
        self.texts: list[list[str]] = []
        self.ink: list[list[int]] = []
        self.scripts: list[list[dict]] = []
        self.template_nodes = _NodeColumns(with_owner=True)
        self.template_texts: list[list[str]] = []
        self.sources: list[str | None] = []
        self.errors: list[str | None] = []

    def add(self, page: str | None, source_marks: tuple[str, ...]) -> None:
        error = None
        inner: list[tuple[int, _Read | _Tree]] = []
        try:
            page = decode_escaped(page or "", self.window)
            found = read_page(page, self.shapes) if self.spans is None else read_tree(page, True)
            held = found.inner if isinstance(found, _Read) else found.text_templates()
            inner = [(owner, read_page(text, self.shapes)) for owner, text in held]
        except Exception as problem:  # one bad page must not end the job
            error = f"{type(problem).__name__}: {problem}"
            found, inner = _Tree(), []
        self.nodes.add(found)
        self.nodes.end_page()
        self.texts.append(found.texts)
        if self.counts_ink:
            self.ink.append(ink_counts(found.texts))
        scripts = found.scripts if isinstance(found, _Tree) else ()
        self.scripts.append([{"pre": pre, "type": kind, "body": body} for pre, kind, body in scripts])
        template_texts: list[str] = []
        for owner, part in inner:
            self.template_nodes.add(part, owner, len(template_texts))
            template_texts.extend(part.texts)
        self.template_nodes.end_page()
        self.template_texts.append(template_texts)
        keep = bool(page) and (
            self.spans is not None or any(mark in page for mark in source_marks)
        )
        if self.spans is not None:
            names = ("start", "inner", "inner_end", "end")
            self.spans.append([dict(zip(names, span, strict=True)) for span in found.spans])
        self.sources.append(page if keep else None)
        self.errors.append(error)

    def arrays(self, names: list[str]) -> list[pa.Array]:
        script = pa.struct([("pre", pa.int32()), ("type", pa.string()), ("body", pa.string())])
        span = pa.struct([(name, pa.int32()) for name in ("start", "inner", "inner_end", "end")])
        make = {
            "nodes": self.nodes.array,
            "texts": lambda: _lists(self.texts, pa.string()),
            "ink": lambda: _lists(self.ink, pa.int32()),
            "scripts": lambda: pa.array(self.scripts, pa.list_(script)),
            "template_nodes": self.template_nodes.array,
            "template_texts": lambda: _lists(self.template_texts, pa.string()),
            "source": lambda: pa.array(self.sources, pa.string()),
            "error": lambda: pa.array(self.errors, pa.string()),
            "spans": lambda: pa.array(self.spans, pa.list_(span)),
        }
        return [make[name]() for name in names]


TREE_COLUMNS = ("nodes", "texts", "ink", "scripts", "template_nodes", "template_texts", "source", "error")


def parse_pages(
    pages: DataFrame,
    html: str = "html",
    source_marks: tuple[str, ...] = (),
    positions: bool = False,
    want: Sequence[str] | None = None,
    escape_window: int = ESCAPE_WINDOW,
    cards: Mapping | None = None,
) -> DataFrame:
    """Adds the page tree to every page row and drops the ``html`` column.

    ``want``: the tree columns to make and hand over, all by default; columns
    are not pruned through the parse, so callers that read few should say so.

    ``escape_window``: how many characters of a page decide whether it is
    escaped as a whole; 0 takes pages as they are.

    ``source_marks``: keep the (decoded) page text in ``source`` for pages that
    contain one of these strings; all other pages drop it here.

    ``positions``: adds ``spans`` (by element) and keeps ``source`` of all pages.

    ``cards``: the configuration of a product list; what the cards of a page hold
    is found where the page is read and handed over as ``cards``, in place of
    the tree (see ``operators/cards.py``; ``plans.variants.variant_rows`` reads it).

    A page that cannot be read keeps its row, with ``error`` set and no nodes.
    """
    if cards is not None:
        from speclake.operators.cards import read_cards

        if want is not None or positions or source_marks:
            raise ValueError("cards are handed over in place of the tree")
        return read_cards(pages, html, cards, escape_window)
    kept = [field for field in pages.schema.fields if field.name != html]
    tree = T.StructType.fromDDL(f"{TREE_FIELDS}, {SPAN_FIELD}" if positions else TREE_FIELDS)
    if want is not None:
        if unknown := set(want) - set(tree.names):
            raise ValueError(f"no such tree columns: {sorted(unknown)}")
        tree = T.StructType([f for f in tree.fields if f.name in want])
    made = tree.names
    schema = T.StructType(kept + tree.fields)
    names = [field.name for field in kept]
    out_names = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = _Shapes()
        # Trees hold no cycles, and looking for some takes a tenth of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            for batch in batches:
                yield from trees(batch, shapes)
        finally:
            if collecting:
                gc.enable()

    def trees(batch: pa.RecordBatch, shapes: _Shapes) -> Iterator[pa.RecordBatch]:
        column = batch.column(batch.schema.get_field_index(html))
        other = [batch.column(batch.schema.get_field_index(name)) for name in names]
        start, size, out = 0, 0, _PageColumns(shapes, positions, escape_window, "ink" in made)
        for row in range(len(column)):
            page = column[row].as_py()
            out.add(page, source_marks)
            size += len(page or "")
            # Trees are larger than their pages, so a large input batch
            # leaves as several output batches.
            if size >= _OUTPUT_CHARS or row + 1 == len(column):
                part = [values.slice(start, row + 1 - start) for values in other]
                yield pa.RecordBatch.from_arrays(part + out.arrays(made), names=out_names)
                start, size, out = row + 1, 0, _PageColumns(shapes, positions, escape_window, "ink" in made)

    return pages.select(*names, html).mapInArrow(read, schema)
