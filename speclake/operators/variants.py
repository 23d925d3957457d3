"""Product lists: one record per card of a listing page."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from speclake.functions.text import clean_list_price, clean_your_price, without_slash
from speclake.functions.urls import absolute_url
from speclake.operators.hits import none, single
from speclake.operators.page import Page, first_of, let
from speclake.operators.selectors import selector

SECTION, KEY = "Product Variants", "Items"
TEXT_FIELDS = (
    "title", "item_reference", "ref", "url", "description", "image",
    "list_price", "your_price", "availability",
)
RECORD = "STRUCT<" + ", ".join(f"{name}: STRING" for name in TEXT_FIELDS) + (
    ", specs: MAP<STRING, STRING>>"
)


def variant_records(
    page: Page,
    container: str = "body",
    variant_selector: str = "",
    base_url: str = "",
    fields: Mapping | None = None,
) -> Column:
    """Records of all cards; a field that is not configured or not found is NULL."""
    fields = fields or {}
    if not variant_selector:
        return F.array().cast(f"ARRAY<{RECORD}>")

    def record(card: Column) -> Column:
        # Every field looks below the card, so what is there is worked out once.
        return let(page.subtree(card), lambda below: fields_of(card, below))

    def fields_of(card: Column, below: Column) -> Column:
        def element(name: str) -> Column:
            return page.first(fields[name], below)

        def text(name: str) -> Column:
            return page.first_text(fields[name], below)

        values: dict[str, Column] = {}
        for name in ("title", "description", "availability"):
            if name in fields:
                values[name] = text(name)
        # A configured item reference rules out the short reference.
        for name in ("item_reference", "ref"):
            if name in fields:
                values[name] = text(name)
                break
        if "url" in fields:
            values["url"] = let(
                element("url")["attrs"]["href"], lambda url: absolute_url(url, base_url)
            )
        if "image" in fields:
            values["image"] = element("image")["attrs"]["src"]
        if "list_price" in fields:
            values["list_price"] = let(
                element("list_price"),
                lambda e: F.when(e.isNotNull(), let(page.raw_text(e, " "), clean_list_price)),
            )
        if "your_price" in fields:
            values["your_price"] = let(
                element("your_price"),
                lambda e: clean_your_price(
                    F.when(e.isNotNull(), page.raw_text(e, " ")).otherwise(
                        _template_text(page, card, fields["your_price"])
                    )
                ),
            )
        columns = [
            values.get(name, F.lit(None).cast("string")).alias(name) for name in TEXT_FIELDS
        ]
        specs = F.lit(None).cast("map<string,string>")
        if "specs" in fields:
            specs = _specs(page, below, fields["specs"])
        return F.struct(*columns, specs.alias("specs"))

    cards = page.select(variant_selector, page.scope(container))
    return F.filter(
        F.transform(cards, record),
        lambda r: F.coalesce(*[r[name] for name in TEXT_FIELDS]).isNotNull()
        | r["specs"].isNotNull(),
    )


def _template_text(page: Page, card: Column, rule: str) -> Column:
    """Text of the first match in the card's templates that hold markup as text.

    Markup that is part of the page needs no second look: it was already
    searched with the card.
    """
    chosen = selector(rule)

    def first_in(owned: Column, owner: Column) -> Column:
        # Each template is a tree of its own, indexed from its own start.
        return let(
            F.filter(owned, lambda n: n["owner"] == owner),
            lambda tree: replace(page, nodes=tree, removed=None).first(chosen),
        )

    def search(owned: Column) -> Column:
        owners = F.array_distinct(F.transform(owned, lambda n: n["owner"]))
        found = F.transform(owners, lambda owner: first_in(owned, owner))
        return first_of(F.filter(found, lambda n: n.isNotNull()))

    owned = F.filter(
        page.template_nodes, lambda n: (n["owner"] > card["pre"]) & (n["owner"] <= card["last"])
    )
    return let(
        let(owned, search),
        lambda n: F.when(
            n.isNotNull(),
            F.array_join(
                F.slice(page.template_texts, n["t0"] + 1, n["t1"] - n["t0"]), " "
            ),
        ),
    )


def _specs(page: Page, below: Column, config: Mapping) -> Column:
    """Nested label and value rows of a card; NULL if there are none."""

    def pair(row: Column) -> Column:
        inner = page.subtree(row)
        return F.struct(
            page.first_text(config["key"], inner).alias("key"),
            page.first_text(config["value"], inner).alias("value"),
        )

    return _spec_map(F.transform(page.select(config["rows"], below), pair))


def _spec_map(told: Column) -> Column:
    pairs = F.filter(told, lambda p: (p["key"] != "") & (p["value"] != ""))
    # The last of equal labels stays, at the place of the first.
    return let(
        pairs,
        lambda ps: F.when(
            F.size(ps) > 0,
            F.map_from_entries(
                F.transform(
                    F.array_distinct(F.transform(ps, lambda p: p["key"])),
                    lambda k: F.struct(
                        k.alias("key"),
                        F.element_at(F.filter(ps, lambda p: p["key"] == k), -1)["value"].alias(
                            "value"
                        ),
                    ),
                )
            ),
        ),
    )


def held_records(cards: Column) -> Column:
    """Cards as found by the parse (``operators/cards.py``) that give a record."""
    plain = [name for name in TEXT_FIELDS if name != "your_price"]
    return F.filter(
        cards,
        lambda c: F.coalesce(*[c[name] for name in plain]).isNotNull()
        | (c["your_price"] != "")
        | F.exists(c["specs"], lambda p: (p["key"] != "") & (p["value"] != "")),
    )


def held_record(card: Column, base_url: str = "") -> dict[str, Column]:
    """Fields of the record of one such card, whose texts are clean."""
    values = {name: card[name] for name in TEXT_FIELDS}
    values["url"] = absolute_url(card["url"], base_url)
    values["list_price"] = without_slash(card["list_price"])
    values["your_price"] = F.nullif(card["your_price"], F.lit(""))
    specs = F.when(card["specs"].isNotNull(), _spec_map(card["specs"]))
    return {**values, "specs": specs}


def product_variants(page: Page, **params) -> Column:
    """All records as one JSON value, counted by card."""
    if not params.get("variant_selector"):
        return none()
    return let(
        variant_records(page, **params),
        lambda records: single(
            SECTION, KEY, F.when(F.size(records) > 0, F.to_json(records)), "json",
            F.size(records),
        ),
    )


def list_variants(page: Page, container: str = "body", variant_selector: str = "",
                  fields: Mapping | None = None) -> Column:
    """Short form: no base address, no prices, no availability."""
    short = ("title", "item_reference", "ref", "url", "description", "image", "specs")
    kept = {name: rule for name, rule in (fields or {}).items() if name in short}
    return product_variants(
        page, container=container, variant_selector=variant_selector, fields=kept
    )
