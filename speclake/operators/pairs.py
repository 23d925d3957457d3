"""Operators that pair labels with values: tables, lists, rows, label lines.

Each takes the page and its parameters and returns an array of hits in page
order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from speclake.functions.text import clean_text
from speclake.operators.hits import hit, none, present
from speclake.operators.page import (
    HEADINGS,
    UNKNOWN,
    Page,
    first_of,
    inside,
    last_of,
    let,
)
from speclake.operators.selectors import Step, tags

LABEL_LINE = r"^(.{2,80}):\s*(.{1,200})$"
# Characters other than white space that a label line holds at most.
LABEL_LINE_MOST = 80 + 1 + 200
LABEL_TAGS = ("p", "li", "div", "span")


def table(
    page: Page,
    container: str = "body",
    tables: str = "table",
    key_column: int = 0,
    value_column: int = 1,
    skip_rows_with_class: str | None = None,
) -> Column:
    """Key and value cell of every table row with at least two cells.

    Rows of a nested table count for the inner and the outer table, as do
    nested cells; spans are ignored.
    """

    def row_hit(row: Column, section: Column) -> Column:
        return let(
            page.select(tags("td", "th"), page.subtree(row)),
            lambda cells: F.when(
                F.size(cells) >= max(2, key_column + 1, value_column + 1),
                hit(
                    section,
                    page.text(F.get(cells, F.lit(key_column))),
                    page.text(F.get(cells, F.lit(value_column))),
                ),
            ),
        )

    def table_hits(element: Column) -> Column:
        skip = (skip_rows_with_class,) if skip_rows_with_class else ()
        rows = page.select(((Step(tag="tr", without=skip),),), page.subtree(element))
        return let(
            page.section(element),
            lambda section: F.transform(rows, lambda row: row_hit(row, section)),
        )

    found = page.select(tables, page.scope(container))
    return present(F.flatten(F.transform(found, table_hits)))


def definition_list(page: Page, container: str = "body") -> Column:
    """n-th term with n-th description of each list; the shorter side ends it."""

    def list_hits(element: Column) -> Column:
        below = page.subtree(element)
        terms = F.transform(page.select(tags("dt"), below), page.text)
        notes = F.transform(page.select(tags("dd"), below), page.text)
        # The longer side is paired with NULL, and ``present`` drops those.
        return let(
            page.section(element),
            lambda section: F.zip_with(terms, notes, lambda k, v: hit(section, k, v)),
        )

    found = page.select(tags("dl"), page.scope(container))
    return present(F.flatten(F.transform(found, list_hits)))


def rows_with_noise(
    page: Page,
    rows: str = "",
    key: str = "",
    value: str = "",
    multiple_values: bool = False,
    remove_noise: Sequence[str] = (),
) -> tuple[Column, Column | None]:
    """``rows`` together with the elements it takes out of the page.

    Rows are read in page order.  A row's key is read before its noise goes, its
    value after it, and what an outer row took out is gone for the rows in it.
    """
    if not (rows and key and value):
        return none(), None

    def value_text(rest: Page, row: Column) -> Column:
        chosen = rest.select(value, rest.subtree(row))
        if multiple_values:
            values = F.filter(F.transform(chosen, rest.text), lambda v: v != "")
            return F.array_join(values, " | ")
        return let(first_of(chosen), rest.text)

    found = page.select(rows)
    if not remove_noise:
        plain = F.transform(
            found,
            lambda row: hit(
                page.section(row), page.first_text(key, page.subtree(row)), value_text(page, row)
            ),
        )
        return present(plain), None

    nothing = F.filter(page.nodes, lambda n: F.lit(False))

    def read(state: Column, row: Column) -> Column:
        # Only what reaches behind the row's start can lie in it, or in a later row.
        return let(
            F.filter(state["near"], lambda x: x["last"] >= row["pre"]),
            lambda near: let(
                page.without(near).first_text(key, page.subtree(row)),
                lambda label: F.when(label != "", cleared(state, row, near, label)).otherwise(state),
            ),
        )

    def cleared(state: Column, row: Column, near: Column, label: Column) -> Column:
        before = page.without(near)

        def after(noise: Column) -> Column:
            text = value_text(before.without(noise), row)
            return F.struct(
                F.concat(near, noise).alias("near"),
                F.concat(state["removed"], noise).alias("removed"),
                F.concat(state["hits"], F.array(hit(page.section(row), label, text))).alias("hits"),
            )

        return let(before.select(", ".join(remove_noise), page.subtree(row)), after)

    start = F.struct(nothing.alias("near"), nothing.alias("removed"), none().alias("hits"))
    # Worked out once: the state is a column of two uses.
    state = F.aggregate(found, start, read)
    return present(state["hits"]), state["removed"]


def rows(page: Page, **params) -> Column:
    """Key and value elements of every row element.

    With ``multiple_values`` all non-empty values are joined by ``" | "``.
    """
    return rows_with_noise(page, **params)[0]


def section_texts(
    page: Page,
    box: Column,
    section_headers: Sequence[str],
    skip_texts: Sequence[str] = (),
    among: Sequence[str] = (),
) -> Column:
    """Place and text of the headers in a container (the page, if NULL), or of all elements
    ``among`` whose tags they are; the text is NULL if it starts no section."""
    skipped = [text.lower() for text in skip_texts]

    def usable(text: Column) -> Column:
        kept = text != ""
        return kept & ~F.lower(text).isin(skipped) if skipped else kept

    def header(h: Column) -> Column:
        starts = h["tag"].isin(list(section_headers)) & (box.isNull() | inside(h, box))
        text = let(F.when(starts, page.text(h)), lambda t: F.when(usable(t), t))
        return F.struct(h["pre"].alias("pre"), text.alias("text"))

    return F.transform(page.select(tags(*(among or section_headers))), header)


def last_section_text(headers: Column) -> Column:
    return last_of(F.filter(headers, lambda h: h["text"].isNotNull()))["text"]


def list_split(
    page: Page,
    container: str = "body",
    section_headers: Sequence[str] = ("h3", "h4"),
    items: str = "li",
    split_on: str = "\n",
    skip_texts: Sequence[str] = (),
    min_parts: int = 2,
) -> Column:
    """First part of an item is the key, the other parts are the value.

    The section is the last header before the item in the container whose text
    is not in ``skip_texts``.
    """
    # Headings are found by their number; other headers by a search.
    numbered = set(section_headers) <= set(HEADINGS)

    def header_texts(box: Column) -> Column:
        return section_texts(page, box, section_headers, skip_texts, HEADINGS if numbered else ())

    last_text = last_section_text

    def section_text(element: Column, headers: Column) -> Column:
        if not numbered:
            return last_text(F.filter(headers, lambda h: h["pre"] < element["pre"]))
        return F.coalesce(
            F.get(headers, element["heads"] - 1)["text"],
            last_text(F.slice(headers, F.lit(1), element["heads"])),
        )

    def item_hit(element: Column, headers: Column) -> Column:
        pieces = F.split(page.raw_text(element, split_on), _quoted(split_on))
        parts = F.filter(F.transform(pieces, clean_text), lambda p: p != "")
        section = F.coalesce(section_text(element, headers), F.lit(UNKNOWN))
        return let(
            parts,
            lambda p: F.when(
                F.size(p) >= min_parts,
                hit(
                    section,
                    first_of(p),
                    F.array_join(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), " "),
                ),
            ),
        )

    def boxed(box: Column) -> Column:
        scope = F.when(box.isNull(), page.nodes).otherwise(page.subtree(box))
        return let(
            header_texts(box),
            lambda hs: F.transform(page.select(items, scope), lambda e: item_hit(e, hs)),
        )

    return present(let(page.first(container), boxed))


def _quoted(separator: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in separator)


def label_value(
    page: Page, pattern: str = LABEL_LINE, elements: Sequence[str] = LABEL_TAGS
) -> Column:
    """Elements whose whole text reads ``label: value``."""
    # Python's $ also matches before a last line break; cleaned text has none.

    def element_hit(element: Column) -> Column:
        return let(
            page.text(element),
            lambda text: F.when(
                text.rlike(pattern),
                hit(
                    page.section(element),
                    F.trim(F.regexp_extract(text, pattern, 1)),
                    F.trim(F.regexp_extract(text, pattern, 2)),
                ),
            ),
        )

    found = page.select(tags(*elements))
    if pattern == LABEL_LINE:
        # Wrappers around whole parts of a page are most of the text to read.
        found = F.filter(found, lambda e: page.fits(e, LABEL_LINE_MOST))
    return present(F.transform(found, element_hit))
