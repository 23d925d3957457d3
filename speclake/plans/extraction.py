"""Pages in, facts and documents out.

``extract_pages`` is one narrow pass: scan, parse, classify, extract.  Every
page runs the operators of its own site only, inside one conditional, so the
pages are read and parsed once and never shuffled, whatever the number of
sites.
"""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speclake.operators.classify import (
    SITE_BY_ADDRESS,
    canonical_url,
    site_name,
    site_of_page,
)
from speclake.operators.embedded import IMAGE_HOST
from speclake.operators.hits import HITS
from speclake.operators.page import last_filled, page_of, with_headings
from speclake.operators.parse import ESCAPE_WINDOW, TREE_COLUMNS, parse_pages
from speclake.operators.registry import python_columns, run_specs
from speclake.plans.assemble import documents_from_hits, kv_raw_from_hits
from speclake.session import require_settings
from speclake.sources.sites import Site, Sites, load_sites


def source_marks(sites: Sites) -> tuple[str, ...]:
    """Strings that a page's text must hold for an operator to search it."""
    wanted = any(
        (spec.get("extract") or {}).get("image", {}).get("search_patterns")
        for site in sites.all()
        for spec in site.specs
        if spec.get("type") == "schneider_json"
    )
    return (IMAGE_HOST,) if wanted else ()


def site_hits(sites: Sites) -> Column:
    """Hits of the operators of the page's site, by the column ``vendor``.

    Kept with the site list, per Spark context: putting together the
    expressions of many sites takes the driver some seconds.
    """
    context = SparkContext._active_spark_context
    kept = _SITE_HITS.get(sites)
    if kept is None or kept[0] is not context:
        kept = _SITE_HITS[sites] = (context, _site_hits(sites))
    return kept[1]


# Goes with its site list.
_SITE_HITS: WeakKeyDictionary[Sites, tuple[SparkContext, Column]] = WeakKeyDictionary()


def _site_hits(sites: Sites) -> Column:
    return by_site(sites, lambda site: run_specs(page_of(), site.specs, site.name)).cast(HITS)


def by_site(sites: Sites, value: Callable[[Site], Column]) -> Column:
    """The value for the page's site, by the column ``vendor``."""
    generic = sites.spec_source("")
    answer = value(generic)
    for site in reversed(sites.all()):
        if site.vendor != generic.vendor:
            answer = F.when(F.col("vendor") == site.vendor, value(site)).otherwise(answer)
    return answer


def read_trees(
    pages: DataFrame,
    sites: Sites | None = None,
    html: str = "html",
    escape_window: int = ESCAPE_WINDOW,
) -> DataFrame:
    """Parsed pages with their headings."""
    marks = source_marks(sites) if sites else ()
    return with_headings(parse_pages(pages, html, marks, escape_window=escape_window))


def extract_pages(
    pages: DataFrame,
    sites: Sites | None = None,
    html: str = "html",
    vendor: Column | None = None,
    by_address: tuple[tuple[str, str], ...] = SITE_BY_ADDRESS,
    escape_window: int = ESCAPE_WINDOW,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per page: the columns of the page other than its text, ``vendor``,
    ``vendor_name``, ``canonical_url``, ``last_heading``, ``hits`` and ``error``.

    ``vendor`` skips classification where the site is known beforehand; ``also``
    adds columns read from the page in the same pass.
    """
    require_settings(pages.sparkSession)
    sites = sites or load_sites()
    page = page_of()
    keys = [name for name in pages.columns if name != html]
    decided = site_of_page(page, sites, by_address) if vendor is None else vendor
    classified = read_trees(pages, sites, html, escape_window).select(
        *keys,
        *TREE_COLUMNS,
        "headings",
        canonical_url(page).alias("canonical_url"),
        decided.alias("vendor"),
    )
    return classified.withColumns(python_columns(sites)).select(
        *keys,
        "vendor",
        site_name(F.col("vendor"), sites).alias("vendor_name"),
        "canonical_url",
        last_filled(F.col("headings")).alias("last_heading"),
        site_hits(sites).alias("hits"),
        *[column.alias(name) for name, column in (also or {}).items()],
        "error",
    )


def extract_facts(pages: DataFrame, sites: Sites | None = None, **options) -> DataFrame:
    """All writes of all pages, one row per write (``kv_raw``)."""
    return kv_raw_from_hits(extract_pages(pages, sites, **options), _keys(pages, options))


def extract_documents(
    pages: DataFrame,
    sites: Sites | None = None,
    extracted_at: Column | None = None,
    **options,
) -> DataFrame:
    """One result document per page."""
    return documents_from_hits(
        extract_pages(pages, sites, **options), _keys(pages, options), extracted_at
    )


def quarantine(extracted: DataFrame) -> DataFrame:
    """Pages that could not be read, with the reason."""
    return extracted.where(F.col("error").isNotNull())


def _keys(pages: DataFrame, options: dict) -> list[str]:
    return [name for name in pages.columns if name != options.get("html", "html")]
