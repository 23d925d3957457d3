"""First matches of a document that comes in fragments.

An operator that takes the first match of a document gives, per fragment, one
*state* or none: none where nothing matched; else its rank (the place of the
selector that matched among its alternatives) and its hits, which are empty if
the match has no value.  The state of least rank, then of the first fragment, is
that of the document.  States combine, so they meet before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from speclake.functions.text import clean_plain_text, strip
from speclake.functions.urls import absolute_url, prefix_by_name
from speclake.operators import downloads, pairs, singles
from speclake.operators.hits import HITS, single, stamp
from speclake.operators.open_elements import MARK
from speclake.operators.page import Page, last_of, let
from speclake.operators.registry import COUNTED_AS

# ``all``: hits of all fragments of the least rank count; ``last``: of the last one.
STATES = f"ARRAY<STRUCT<spec_ord INT, rank INT, take STRING, hits {HITS}>>"

State = tuple[Column, Column, Column]  # whether something matched, rank, hits


def _target(spec: dict, section: str, key: str) -> tuple[str, str]:
    return spec.get("target_section", section), spec.get("target_key", key)


def _attribute(page: Page, spec: dict, site_name: str) -> State:
    found = page.first(spec["selector"])
    value = found["attrs"][spec.get("attribute", "href")]
    if spec.get("post_process") == "prepend_base_url":
        value = let(value, lambda url: prefix_by_name(url, site_name))
    return found.isNotNull(), F.lit(0), single(*_target(spec, "General", "Attribute"), value)


def _text(page: Page, spec: dict, _site_name: str) -> State:
    found = page.first(spec["selector"])
    value = let(found, lambda e: clean_plain_text(page.raw_text(e, " ")))
    return found.isNotNull(), F.lit(0), single(*_target(spec, "General", "Text"), value)


def _meta(page: Page, spec: dict, _site_name: str) -> State:
    found = page.first(spec.get("selector", "meta[name='description']"))
    value = strip(found["attrs"][spec.get("attribute", "content")])
    return found.isNotNull(), F.lit(0), single(*_target(spec, "General", "Description"), value)


def _ranked(tries: list[Column], hits: Callable[[Column], Column]) -> State:
    """State of the first of several tries that is not NULL."""
    rank = F.lit(None).cast("int")
    for i, found in reversed(list(enumerate(tries))):
        rank = F.when(found.isNotNull(), F.lit(i)).otherwise(rank)
    return rank.isNotNull(), rank, let(F.coalesce(*tries), hits)


def _datasheet(page: Page, spec: dict, _site_name: str) -> State | None:
    selectors = spec.get("selectors") or ()
    if not selectors:
        return None
    tries = singles.datasheet_tries(page, selectors, spec.get("attribute", "href"))
    target = _target(spec, "Downloads", "Datasheet")
    return _ranked(tries, lambda url: single(*target, absolute_url(url, spec.get("base_url", ""))))


def _image(page: Page, spec: dict, _site_name: str) -> State | None:
    lists = singles.image_tries(
        page, spec.get("selectors", ()), spec.get("selector", ""), spec.get("attribute", "src")
    )
    take = spec.get("take", "first")
    tries = [F.when(F.size(urls) > 0, urls) for urls in lists]
    if spec.get("fallback_jsonld") and take != "all":
        tries.append(let(singles.json_ld_image(page), lambda u: F.when(u.isNotNull(), F.array(u))))
    if not tries:
        return None
    target = _target(spec, "Product Info", "Image URL")

    def hits(urls: Column) -> Column:
        if take == "all":
            return single(*target, F.to_json(urls), "json", F.size(urls))
        return single(*target, F.get(urls, F.lit(0)) if take == "first" else last_of(urls))

    return _ranked(tries, hits)


def _cards(page: Page, spec: dict, _site_name: str) -> State:
    names = ("target_section", "base_url", "cards_selector", "card_selector")
    chosen = {name: spec[name] for name in names if name in spec}
    box = {"cards_selector": spec["cards_selector"]} if "cards_selector" in spec else {}
    return downloads.has_document_cards(page, **box), F.lit(0), downloads.document_cards(page, **chosen)


FIRST_STATES: dict[str, Callable[[Page, dict, str], State | None]] = {
    "attribute": _attribute,
    "text": _text,
    "meta_description": _meta,
    "datasheet_link": _datasheet,
    "image": _image,
    "vega_pdf": _cards,
}


def _usable(specs: tuple[dict, ...]):
    """Specs in order with the page as they see it: without noise that earlier ones took out."""

    def walk(page: Page, at: int, take: Callable[[Page, int, dict], Column | None], found: list[Column]):
        while at < len(specs):
            spec = specs[at]
            try:
                value = take(page, at, spec)
                if value is not None:
                    found = [*found, value]
                removed = None
                if spec.get("type") == "rows" and spec.get("remove_noise"):
                    names = ("rows", "key", "value", "multiple_values", "remove_noise")
                    _, removed = pairs.rows_with_noise(page, **{n: spec[n] for n in names if n in spec})
            except Exception:  # told, and skipped, where its hits are put together
                removed = None
            at += 1
            if removed is not None:
                return let(removed, lambda gone: walk(page.without(gone), at, take, found))
        return F.concat(*found) if found else None

    return walk


def first_states(page: Page, specs: tuple[dict, ...], site_name: str) -> Column:
    """States of all specs that take the first match of a document."""

    def take(page: Page, at: int, spec: dict) -> Column | None:
        kind = spec.get("type")
        state = FIRST_STATES[kind](page, spec, site_name) if kind in FIRST_STATES else None
        if state is None:
            return None
        matched, rank, hits = state
        one = F.struct(
            F.lit(at).alias("spec_ord"),
            rank.cast("int").alias("rank"),
            F.lit(spec.get("take", "first") if kind == "image" else "first").alias("take"),
            stamp(hits, at, COUNTED_AS.get(kind, kind)).cast(HITS).alias("hits"),
        )
        return F.when(matched, F.array(one)).otherwise(F.array()).cast(STATES)

    found = _usable(specs)(page, 0, take, [])
    return (F.array() if found is None else found).cast(STATES)


HEADERS = "ARRAY<STRUCT<spec_ord INT, text STRING>>"


def last_headers(page: Page, specs: tuple[dict, ...]) -> Column:
    """The header that a list operator's running section ends with, per operator; NULL: none."""

    def take(page: Page, at: int, spec: dict) -> Column | None:
        if spec.get("type") != "li_split":
            return None
        text = let(
            page.first(spec.get("container", "body")),
            lambda box: let(
                pairs.section_texts(
                    page, box, spec.get("section_headers", ("h3", "h4")), spec.get("skip_texts", ())
                ),
                pairs.last_section_text,
            ),
        )
        return F.array(F.struct(F.lit(at).alias("spec_ord"), text.alias("text"))).cast(HEADERS)

    found = _usable(specs)(page, 0, take, [])
    return (F.array() if found is None else found).cast(HEADERS)


BOXES = "ARRAY<STRUCT<spec_ord INT, box STRING>>"
# Types that read below a container.
IN_CONTAINER = ("table", "dl", "li_split", "product_variants", "list_variants")


def boxes(page: Page, specs: tuple[dict, ...], number: Column, opened: Column) -> Column:
    """Which element each operator's container is; NULL: none.

    An element is named by the piece that opens it and its place there: by its
    mark if it was opened before, else by ``number`` and its place in the page,
    less the ``opened`` elements that the piece begins in.
    """

    def take(page: Page, at: int, spec: dict) -> Column | None:
        container = spec.get("container", "body")
        if spec.get("type") not in IN_CONTAINER or not container:
            return None
        name = let(
            page.first(container),
            lambda box: F.when(
                box.isNotNull(),
                F.coalesce(box["attrs"][MARK], F.concat(number, box["pre"] - opened)),
            ),
        )
        return F.array(F.struct(F.lit(at).alias("spec_ord"), name.alias("box"))).cast(BOXES)

    found = _usable(specs)(page, 0, take, [])
    return (F.array() if found is None else found).cast(BOXES)
