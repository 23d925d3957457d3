"""Download addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speclake.functions.text import strip
from speclake.functions.urls import article_pdf_url, prefix_base, trailing_article
from speclake.operators.classify import canonical_url
from speclake.operators.hits import hit, none, present, single
from speclake.operators.page import Page, first_of, last_of, let
from speclake.operators.selectors import tags


def article_pdf(
    page: Page,
    earlier: Column,
    article_key: str = "Artikelnummer",
    article_section: str = "Productdetails",
    target_section: str = "Downloads",
    target_key: str = "PDF Datasheet",
    realm: str = "be",
    locale: str = "nl-BE",
) -> Column:
    """Data sheet address made from the article number.

    The number is what earlier operators last wrote under the article key, else
    the digits that end the canonical address.
    """
    written = last_of(
        F.filter(
            earlier, lambda h: (h["section"] == article_section) & (h["key"] == article_key)
        )
    )["value"]
    article = F.coalesce(
        F.nullif(written, F.lit("")), trailing_article(canonical_url(page))
    )
    return single(target_section, target_key, article_pdf_url(article, realm, locale))


def document_cards(
    page: Page,
    target_section: str = "Downloads",
    base_url: str = "https://www.vega.com",
    cards_selector: str = "div.cards",
    card_selector: str = "div.card",
) -> Column:
    """One address per document card of the first card container."""

    def card_hit(card: Column) -> Column:
        below = page.subtree(card)
        title = let(
            first_of(page.select(tags("h3"), below)),
            lambda h3: F.when(
                h3.isNotNull(), F.array_join(F.transform(page.runs(h3), strip), "")
            ),
        )
        address = strip(
            page.first("li.language.selected[data-url]", below)["attrs"]["data-url"]
        )
        return hit(
            F.lit(target_section),
            title,
            let(address, lambda url: F.when(url != "", prefix_base(url, base_url))),
        )

    return let(
        page.first(cards_selector),
        lambda box: F.when(
            box.isNotNull(),
            present(F.transform(page.select(card_selector, page.subtree(box)), card_hit)),
        ).otherwise(none()),
    )


def has_document_cards(page: Page, cards_selector: str = "div.cards") -> Column:
    return page.first(cards_selector).isNotNull()
