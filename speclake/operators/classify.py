"""Which site a page belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speclake.operators.page import Page, first_of, let
from speclake.operators.selectors import Step
from speclake.sources.sites import DetectRule, Sites

GENERIC = "generic"

# Address part -> site, first match wins, whole address searched.
SITE_BY_ADDRESS = (
    ("new.abb.com", "abb"),
    ("abb.com", "abb"),
    ("phoenixcontact.com", "phoenix"),
    ("new.schneider-electric.com", "schneider"),
    ("se.com", "schneider"),
    ("siemens.com", "siemens"),
    ("mall.industry.siemens.com", "siemens"),
    ("sieportal.siemens.com", "siemens"),
    ("vega.com", "vega"),
    ("nexans.", "nexans"),
)


def canonical_url(page: Page) -> Column:
    """``href`` of the first canonical link; NULL if it has none."""
    links = F.filter(
        page.nodes,
        lambda n: (n["tag"] == "link")
        & F.array_contains(F.split(n["attrs"]["rel"], r"\s+"), "canonical"),
    )
    return first_of(links)["attrs"]["href"]


def site_by_address(url: Column, rules: tuple[tuple[str, str], ...] = SITE_BY_ADDRESS) -> Column:
    low = F.lower(url)
    answer = F.lit(None).cast("string")
    for mark, site in reversed(rules):
        answer = F.when(F.contains(low, F.lit(mark)), F.lit(site)).otherwise(answer)
    return answer


def page_text_lower(page: Page) -> Column:
    return F.lower(F.array_join(page.texts, ""))


def rule_holds(page: Page, rule: DetectRule, page_text: Column | None) -> Column:
    if rule.kind == "id":
        return F.exists(page.nodes, lambda n: Step(id=rule.arg).holds(n))
    if rule.kind == "selector":
        return F.size(page.select(rule.arg)) > 0
    if rule.kind == "class_contains":
        # The joined list holds every class name, and their sequence too.
        return F.exists(
            page.nodes,
            lambda n: F.contains(F.array_join(n["classes"], " "), F.lit(rule.arg)),
        )
    if rule.kind == "text_contains":
        return F.contains(page_text, F.lit(rule.arg.lower()))
    # Rules of other kinds are read and never hold.
    return F.lit(False)


def site_by_rules(page: Page, sites: Sites) -> Column:
    """First site, by priority and rule order, with a rule that holds.

    One conditional: later rules run only on pages that earlier ones missed,
    and page text is put together only where a text rule is reached.
    """
    rules = sites.rules_in_order()

    def decide(at: int, text: Column | None) -> Column:
        if at == len(rules):
            return F.lit(GENERIC)
        vendor, rule = rules[at]
        if rule.kind == "text_contains" and text is None:
            return let(page_text_lower(page), lambda joined: decide(at, joined))
        holds = rule_holds(page, rule, text)
        return F.when(holds, F.lit(vendor)).otherwise(decide(at + 1, text))

    return decide(0, None)


def site_of_page(
    page: Page, sites: Sites, by_address: tuple[tuple[str, str], ...] = SITE_BY_ADDRESS
) -> Column:
    """The canonical address decides if it can, else the rules."""
    return F.coalesce(
        let(canonical_url(page), lambda url: site_by_address(url, by_address)),
        site_by_rules(page, sites),
    )


def site_name(vendor: Column, sites: Sites) -> Column:
    """Display name; unknown sites use the generic entry."""
    answer = F.lit(sites.spec_source(GENERIC).name)
    for site in reversed(sites.all()):
        answer = F.when(vendor == site.vendor, F.lit(site.name)).otherwise(answer)
    return answer
