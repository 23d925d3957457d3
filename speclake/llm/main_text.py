"""Main text of web pages by the ratio of text to tags.

The standard library's parser sends events while a page is fed in pieces.
Blocks become lines; a line's ratio is its text over its tags, with text in
links left out.  Ratios are smoothed with a Gaussian along the page, and a
threshold from their spread parts content lines from the rest.  The region is
the innermost element that holds most of the content lines' text; an article
or main element is not entered further, and there every line counts, lists and
tables of links too.  Elsewhere the region starts and ends at content lines,
and list items and cells that are links for the most part are left out.

Markup that says what it is never counts, be it a block or inside one:
navigation, headers, footers, asides, forms, scripts, styles, notices, adverts
and reader comments, by element, role, class or id.  A class or id says so only
by its last word, words of layout left out (``post-comments``, ``sidebar-left``,
but not ``has-sidebar`` or ``notice-period``), and no name takes out an element
that turns out to hold the first article or main element.

One page is one row and the unit of work: nothing is shuffled.

Defined cases: NULL and empty pages, and pages without text, give an empty
text; repeated rows are each read; an empty table gives no rows; columns other
than those named are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speclake.llm import words as W
from speclake.llm.shared import arrow_schema, in_arrow

FEED = 1 << 16
SIGMA = 1.5  # of the Gaussian, in lines
THRESHOLD = 0.5  # of the standard deviation of smoothed ratios
MOST = 0.6  # share of the content's text that a region must hold

# What HTML's elements are.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noscript ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"br", "html", "head", "body", "option", "optgroup"}
APART = frozenset(
    "nav header footer aside form script style noscript template button select textarea iframe "
    "object svg canvas audio video dialog menu head title search math map".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar "
    "toolbar status".split()
)
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup signin login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars "
    "aside widget widgets footer masthead topbar toolbar comment comments respond replies disqus "
    "share sharing social related recommended recommendations pagination pager skip hidden search "
    "searchbox form".split()
)
OUTER_NAMES = NAMES | {"header"}
REMARKS = frozenset("comment comments respond replies disqus".split())
# Words of layout behind a name, and words before it that turn its meaning.
LAYOUT = frozenset(
    "area bar block box bottom button buttons center column container content group inner item items "
    "left link links list outer panel posts right section slot thread top unit wrap wrapper".split()
)
TURNED = frozenset("has with without no not is layout body".split())
WHOLE = frozenset("html body main article".split())
CONTENT = frozenset("main article".split())
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


# Why an element is apart: not at all, by its name only, for sure.
IN, NAMED, OUT = range(3)


class Line:
    __slots__ = ("text", "linked", "tags", "block", "tag")

    def __init__(self, text, linked, tags, block, tag):
        self.text, self.linked, self.tags = text, linked, tags
        self.block, self.tag = block, tag  # number and name of the innermost block


class Reader(HTMLParser):
    """Turns parser events into lines; elements that are apart only count as tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, int]] = []  # name, number, apart
        self.counts: Counter[str] = Counter()  # open elements by name
        self.names: dict[int, str] = {0: "html"}
        self.blocks: list[int] = [0]  # open blocks
        self.parents: dict[int, int] = {}  # of blocks, in document order
        self.parts: list[str] = []
        self.linked, self.tags, self.content, self.skipped = 0, 0, 0, False
        self.met = False  # an article or main element

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            block = self.blocks[-1]
            tag = self.names[block] if block else ""
            self.lines.append(Line(text, self.linked, max(1, self.tags), block, tag))
        if text or self.skipped:
            self.tags = 0
        self.parts, self.linked, self.skipped = [], 0, False

    def _apart(self, tag, attrs) -> int:
        if tag in WHOLE:
            return IN
        if tag == "header" and self.content:
            return IN  # an article's own header: its headings count, see handle_data
        if tag in APART:
            return OUT
        given = dict(attrs)
        if given.get("role", "") in ROLES or given.get("aria-hidden") == "true" or "hidden" in given:
            return OUT
        if "none" in (given.get("style") or "") and re.search(r"display\s*:\s*none", given["style"]):
            return OUT
        names = f"{given.get('class') or ''} {given.get('id') or ''}".split()
        known = NAMES if self.content else OUTER_NAMES
        found = {self._last_word(name) for name in names} & known
        return IN if not found else OUT if found & REMARKS else NAMED

    @staticmethod
    def _last_word(name: str) -> str:
        words = [t.lower() for t in _TOKENS.findall(name)]
        while len(words) > 1 and words[-1] in LAYOUT:
            words.pop()
        return "" if not words or words[0] in TURNED else words[-1]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag in CLOSES_P and any(x[0] == "p" for x in self.open[-8:]):
            self._close("p")
        elif tag == "li" and self.open and self.open[-1][0] == "li":
            self._close("li")
        above = self.open[-1][2] if self.open else IN
        if tag in CONTENT and above == NAMED and not self.met:
            # A wrapper, whatever it is called.
            self.open = [(name, n, IN if apart == NAMED else apart) for name, n, apart in self.open]
            above = IN
        apart = above or self._apart(tag, attrs)
        number = len(self.names)
        self.names[number] = tag
        self.open.append((tag, number, apart))
        self.counts[tag] += 1
        if tag in BLOCKS:
            self.parents[number] = self.blocks[-1]
            self.blocks.append(number)
        if tag in CONTENT and not apart:
            self.content += 1
            self.met = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag not in VOID:
            self._close(tag)

    def _close(self, tag):
        """Closes the innermost such element, unless it lies outside a stronger one."""
        if not self.counts[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                for gone, _, apart in self.open[i:]:
                    self.counts[gone] -= 1
                    if gone in BLOCKS:
                        self.blocks.pop()
                    self.content -= gone in CONTENT and not apart
                del self.open[i:]
                return
            if tag == "p" and name in ("table", "td", "th", "button") or (
                tag not in BLOCKS and name in BLOCKS and name != "p"
            ):
                return

    def handle_data(self, data):
        if self.open and self.open[-1][2]:
            self.skipped = self.skipped or bool(data.strip())
            return
        if self.content and self.counts["header"] and not any(self.counts[h] for h in HEADINGS):
            return
        self.parts.append(data)
        if self.counts["a"]:
            self.linked += len(data.strip())


def smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing along the page."""
    reach = int(3 * SIGMA)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    padded = np.pad(values, reach)
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def region_of(lines: list[Line], chosen: list[int], reader: Reader) -> int:
    """The innermost element that holds most of the chosen lines' text."""
    names, parents = reader.names, reader.parents
    held = dict.fromkeys([0, *parents], 0)
    for i in chosen:
        held[lines[i].block] += len(lines[i].text)
    total = sum(held.values())
    for block in reversed(parents):  # children come after their parents
        held[parents[block]] += held[block]
    heaviest: dict[int, int] = {}
    for block, parent in parents.items():
        if held[block] > held.get(heaviest.get(parent), 0):
            heaviest[parent] = block
    region = 0
    while names.get(region) not in CONTENT:
        best = heaviest.get(region)
        if best is None or held[best] < MOST * total or names[best] in ("p", "li", "pre"):
            return region
        region = best
    return region


def blocks_below(reader: Reader, wanted) -> set[int]:
    """Blocks for which ``wanted`` holds, and all blocks in them."""
    found = {0} if wanted(0) else set()
    for block, parent in reader.parents.items():
        if parent in found or wanted(block):
            found.add(block)
    return found


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    reader = Reader()
    for at in range(0, len(page), FEED):
        reader.feed(page[at : at + FEED])
    reader.close()
    reader.flush()
    lines = reader.lines
    if not lines:
        return ""
    plain = np.array([max(0, len(x.text) - x.linked) for x in lines], float)
    ratios = smoothed(plain / np.array([x.tags for x in lines]))
    limit = THRESHOLD * ratios.std()
    chosen = [i for i, r in enumerate(ratios) if r >= limit and plain[i] > 0]
    if not chosen:
        chosen = [i for i in range(len(lines)) if plain[i] > 0]
    if not chosen:
        return ""
    region = region_of(lines, chosen, reader)
    below = blocks_below(reader, lambda block: block == region)
    inside = [i for i, x in enumerate(lines) if x.block in below]
    if reader.names.get(region) not in CONTENT:
        sure, here = set(chosen), set(inside)
        known = [i for i in inside if i in sure]
        low, high = known[0], known[-1]
        while low - 1 in here and lines[low - 1].tag in HEADINGS:
            low -= 1
        inside = [i for i in inside if low <= i <= high]
        if not any(lines[i].tag == "h1" for i in inside):
            titles = [i for i, x in enumerate(lines) if x.tag == "h1" and i < inside[0]]
            inside = titles[-1:] + inside
    links = ("li", "td", "dd", "ul", "ol")
    whole = blocks_below(reader, lambda block: reader.names[block] in CONTENT)
    kept = [
        x.text
        for x in (lines[i] for i in inside)
        if not (x.tag in links and x.linked >= 0.8 * len(x.text)) or x.block in whole
    ]
    return " ".join(kept)


def extract(
    pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html: str = "html"
) -> DataFrame:
    """Per page: its keys, the main text, and the number of its code points."""
    held = pages.select(*keys, F.col(html).cast("string").alias("_html"))
    own = T._parse_datatype_string("text STRING, n_chars LONG")
    schema = T.StructType([*held.schema.fields[:-1], *own.fields])
    shape = arrow_schema(schema)

    def step(batch):
        for some in W.slices(batch, "_html"):
            texts = [main_text(t) for t in some.column(len(keys)).to_pylist()]
            yield pa.record_batch(
                [
                    *some.columns[: len(keys)],
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                schema=shape,
            )

    return in_arrow(held, step, schema)
