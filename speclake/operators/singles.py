"""Operators that give at most one hit per page (image lists may hold several)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from speclake.functions.json_paths import parse_strict
from speclake.functions.text import clean_plain_text, clean_text, strip
from speclake.functions.urls import (
    DATASHEET_WORDS,
    absolute_url,
    is_datasheet_url,
    prefix_by_name,
)
from speclake.operators.hits import none, single
from speclake.operators.page import Page, first_of, last_of, let
from speclake.operators.selectors import Step


def attribute(
    page: Page,
    selector: str,
    attribute: str = "href",
    target_section: str = "General",
    target_key: str = "Attribute",
    post_process: str | None = None,
    site_name: str = "",
) -> Column:
    """Attribute of the first match; nothing if that element lacks it."""
    value = page.first(selector)["attrs"][attribute]
    if post_process == "prepend_base_url":
        value = let(value, lambda url: prefix_by_name(url, site_name))
    return single(target_section, target_key, value)


def text(
    page: Page, selector: str, target_section: str = "General", target_key: str = "Text"
) -> Column:
    """Running text of the first match."""
    value = let(
        page.first(selector),
        lambda e: F.when(e.isNotNull(), clean_plain_text(page.raw_text(e, " "))),
    )
    return single(target_section, target_key, value)


def meta_description(
    page: Page,
    selector: str = "meta[name='description']",
    attribute: str = "content",
    target_section: str = "General",
    target_key: str = "Description",
) -> Column:
    value = strip(page.first(selector)["attrs"][attribute])
    return single(target_section, target_key, value)


def names_datasheet(page: Page, element: Column) -> Column:
    """Whether the text of a link speaks of a datasheet."""

    def has_word(words: Column) -> Column:
        found = F.lit(False)
        for word in DATASHEET_WORDS:
            found = found | F.contains(words, F.lit(word))
        return found

    return let(F.lower(clean_text(page.raw_text(element))), has_word)


def datasheet_link(
    page: Page,
    selectors: Sequence[str] = (),
    attribute: str = "href",
    target_section: str = "Downloads",
    target_key: str = "Datasheet",
    base_url: str = "",
) -> Column:
    """First datasheet address: by selector in order, else by link text."""
    if not selectors:
        return none()

    tries = datasheet_tries(page, selectors, attribute)
    address = let(F.coalesce(*tries), lambda url: absolute_url(url, base_url))
    return single(target_section, target_key, address)


def datasheet_tries(page: Page, selectors: Sequence[str], attribute: str) -> list[Column]:
    """First datasheet address by each selector, then by link text."""

    def addresses(elements: Column) -> Column:
        held = F.transform(elements, lambda e: e["attrs"][attribute])
        return F.filter(held, is_datasheet_url)

    links = page.select(((Step(tag="a", attrs=(("href", "", ""),)),),))
    # The address test is cheaper than the text test and goes first.
    by_text = F.filter(
        links, lambda e: let(e["attrs"]["href"], is_datasheet_url) & names_datasheet(page, e)
    )
    return [
        *[first_of(addresses(page.select(rule))) for rule in selectors],
        first_of(by_text)["attrs"]["href"],
    ]


def image(
    page: Page,
    selectors: Sequence[str] = (),
    selector: str = "",
    attribute: str = "src",
    target_section: str = "Product Info",
    target_key: str = "Image URL",
    take: str = "first",
    fallback_jsonld: bool = False,
) -> Column:
    """Address of the first, last or every image that has the attribute.

    The first selector with such an image decides.  ``all`` writes a JSON list
    and counts its members.
    """
    found = image_tries(page, selectors, selector, attribute)
    chosen = F.array().cast("array<string>")
    for urls in reversed(found):
        chosen = _first_filled(urls, chosen)

    def write(urls: Column) -> Column:
        if take == "all":
            value = F.when(F.size(urls) > 0, F.to_json(urls))
            return single(target_section, target_key, value, "json", F.size(urls))
        pick = first_of(urls) if take == "first" else last_of(urls)
        if fallback_jsonld:
            pick = F.coalesce(pick, json_ld_image(page))
        return single(target_section, target_key, pick)

    return let(chosen, write)


def image_tries(
    page: Page, selectors: Sequence[str], selector: str, attribute: str
) -> list[Column]:
    """Addresses of the images by each selector."""
    rules = [selectors] if isinstance(selectors, str) else list(selectors)
    rules = [rule for rule in rules or [selector] if rule]
    return [
        F.filter(
            F.transform(page.select(rule), lambda e: e["attrs"][attribute]),
            lambda url: url.isNotNull(),
        )
        for rule in rules
    ]


def _first_filled(urls: Column, others: Column) -> Column:
    return let(urls, lambda u: F.when(F.size(u) > 0, u).otherwise(others))


LD_JSON_TYPE = "application/ld+json"
_LEVEL = "array<struct<place:array<int>,body:string>>"
_FOUND = "array<struct<place:array<int>,url:string>>"


def json_ld_bodies(page: Page) -> Column:
    """Structured-data scripts that are well-formed, in page order."""
    marked = F.filter(page.scripts, lambda s: s["type"] == LD_JSON_TYPE)
    return F.filter(
        F.transform(marked, lambda s: s["body"]), lambda b: parse_strict(b).isNotNull()
    )


def json_ld_image(page: Page) -> Column:
    """First image address in the structured data, searched depth first.

    The search goes down one level per turn and remembers the place of every
    part, so the smallest place among the finds is the first in reading order.
    There are never more levels than opening brackets, hence the turn count.
    """

    def is_object(body: Column) -> Column:
        return F.startswith(body, F.lit("{"))

    def is_list(body: Column) -> Column:
        return F.startswith(body, F.lit("["))

    def as_object(body: Column) -> Column:
        return F.when(is_object(body), F.from_json(body, "map<string,string>"))

    def as_list(body: Column) -> Column:
        return F.when(is_list(body), F.from_json(body, "array<string>"))

    def address(body: Column) -> Column:
        """Address under ``image``; NULL if the part must be searched further."""
        def url_of(part: Column) -> Column:
            return F.coalesce(F.get_json_object(part, "$.url"), F.lit(""))

        def from_held(held: Column) -> Column:
            in_list = let(
                first_of(as_list(held)),
                lambda first: F.when(is_object(first), url_of(first)).otherwise(first),
            )
            return (
                F.when(is_list(held), in_list)
                .when(is_object(held), url_of(held))
                .otherwise(held)
            )

        return let(as_object(body)["image"], from_held)

    def parts(part: Column) -> Column:
        bodies = F.coalesce(
            as_list(part["body"]), F.map_values(as_object(part["body"])),
            F.array().cast("array<string>"),
        )
        return F.transform(
            bodies,
            lambda body, i: F.struct(
                F.concat(part["place"], F.array(i)).alias("place"), body.alias("body")
            ),
        )

    def turn(state: Column, _n: Column) -> Column:
        seen = F.transform(
            state["level"],
            lambda p: F.struct(p["place"].alias("place"), address(p["body"]).alias("url")),
        )
        open_parts = F.filter(state["level"], lambda p: address(p["body"]).isNull())
        return F.struct(
            F.flatten(F.transform(open_parts, parts)).cast(_LEVEL).alias("level"),
            F.concat(state["found"], F.filter(seen, lambda f: f["url"] != ""))
            .cast(_FOUND)
            .alias("found"),
        )

    def search(bodies: Column) -> Column:
        top = F.transform(
            bodies, lambda body, i: F.struct(F.array(i).alias("place"), body.alias("body"))
        )
        deepest = F.array_max(
            F.transform(bodies, lambda b: F.length(F.regexp_replace(b, r"[^{\[]", "")))
        )
        start = F.struct(
            top.cast(_LEVEL).alias("level"), F.array().cast(_FOUND).alias("found")
        )
        turns = F.sequence(F.lit(0), F.coalesce(deepest, F.lit(0)))
        return F.aggregate(
            turns, start, turn, lambda state: F.array_min(state["found"])["url"]
        )

    return let(json_ld_bodies(page), search)
