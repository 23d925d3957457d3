"""Extraction for any number of sites: sites are a table, and the plan does not grow with them.

`plans.extraction` builds one conditional per site and spec, which suits a few
sites whose operators need plans of their own.  Here

* detection rules go to the workers as data (`operators.site_data`),
* a page is joined to its site's row by the site's name, an equi-join whose small
  side is broadcast behind a check of its size,
* specs are structs on that row, read by one expression per operator type.

Sites with specs that can't be read as data (embedded JSON, product lists, noise
that later specs must not see, own operators) are dealt by *group*: sites whose
name and specs are equal share one branch, all others none.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speclake.operators.classify import GENERIC, SITE_BY_ADDRESS, canonical_url
from speclake.operators.hits import HITS
from speclake.operators.page import last_filled, page_of
from speclake.operators.parse import ESCAPE_WINDOW, TREE_COLUMNS
from speclake.operators.registry import python_columns, run_specs
from speclake.operators.site_data import (
    SPEC,
    address_matcher,
    hits_by_data,
    site_by_rule_data,
    specs_as_data,
)
from speclake.plans.extraction import read_trees
from speclake.session import require_settings
from speclake.sources.sites import Site, Sites, load_sites

# A table of sites of more bytes is joined by shuffle.
BROADCAST_BYTES = 64 << 20


def _group(site: Site) -> str:
    return json.dumps([site.name, site.specs], sort_keys=True, ensure_ascii=False)


def own_groups(sites: Sites) -> dict[str, tuple[int, Site]]:
    """Groups of sites that need plans of their own: number and one of the sites."""
    groups: dict[str, tuple[int, Site]] = {}
    for site in sites.all():
        if specs_as_data(site.specs) is None:
            groups.setdefault(_group(site), (len(groups) + 1, site))
    return groups


def site_table(spark: SparkSession, sites: Sites) -> tuple[DataFrame, int]:
    """One row per site (``_site``, ``vendor_name``, ``_group``, ``_specs``), and its size in bytes.

    Group 0 reads its specs as data.
    """
    groups = own_groups(sites)
    rows = []
    for site in sites.all():
        specs = specs_as_data(site.specs)
        number = 0 if specs is not None else groups[_group(site)][0]
        rows.append((site.vendor, site.name, number, specs or []))
    size = len(json.dumps(rows, default=str))
    schema = f"_site STRING, vendor_name STRING, _group INT, _specs ARRAY<{SPEC}>"
    return spark.createDataFrame(rows, schema), size


def classified(
    pages: DataFrame,
    sites: Sites,
    keys: list[str],
    by_address: tuple[tuple[str, str], ...] = SITE_BY_ADDRESS,
) -> DataFrame:
    """Parsed pages with ``canonical_url`` and ``vendor``."""
    page = page_of()
    rules = [(vendor, rule.kind, rule.arg) for vendor, rule in sites.rules_in_order()]
    addressed = pages.withColumn("canonical_url", canonical_url(page)).withColumn(
        "_addressed", address_matcher(by_address)(F.col("canonical_url"))
    )
    decided = F.coalesce(
        "_addressed", site_by_rule_data(page, rules, F.col("_addressed").isNull()), F.lit(GENERIC)
    )
    return addressed.select(*keys, *TREE_COLUMNS, "headings", "canonical_url", decided.alias("vendor"))


def extract_pages(
    pages: DataFrame,
    sites: Sites | None = None,
    html: str = "html",
    vendor: Column | None = None,
    by_address: tuple[tuple[str, str], ...] = SITE_BY_ADDRESS,
    escape_window: int = ESCAPE_WINDOW,
) -> DataFrame:
    """The rows of ``extraction.extract_pages``, by a plan of the same size for any number of sites."""
    spark = pages.sparkSession
    require_settings(spark)
    sites = sites or load_sites()
    keys = [name for name in pages.columns if name != html]
    trees = read_trees(pages, sites, html, escape_window)
    if vendor is None:
        known = classified(trees, sites, keys, by_address)
    else:
        known = trees.select(
            *keys, *TREE_COLUMNS, "headings", canonical_url(page_of()).alias("canonical_url"),
            vendor.alias("vendor"),
        )
    table, size = site_table(spark, sites)
    if size <= BROADCAST_BYTES:
        table = F.broadcast(table)
    wanted = F.col("vendor")
    if any(site.vendor == GENERIC for site in sites.all()):
        # Pages of unknown sites take the generic entry.
        exists = table.select(F.col("_site").alias("_known"))
        known = known.join(exists, wanted == F.col("_known"), "left")
        wanted = F.coalesce("_known", F.lit(GENERIC))
    joined = known.withColumns(python_columns(sites)).withColumn("_wanted", wanted).join(table, F.col("_wanted") == F.col("_site"), "left")
    page = page_of()
    hits = hits_by_data(page, F.col("_specs"))
    for number, site in own_groups(sites).values():
        hits = F.when(F.col("_group") == number, run_specs(page, site.specs, site.name)).otherwise(hits)
    generic = sites.spec_source(GENERIC).name
    return joined.select(
        *keys,
        "vendor",
        F.coalesce("vendor_name", F.lit(generic)).alias("vendor_name"),
        "canonical_url",
        last_filled(F.col("headings")).alias("last_heading"),
        F.coalesce(hits.cast(HITS), F.array().cast(HITS)).alias("hits"),
        "error",
    )
