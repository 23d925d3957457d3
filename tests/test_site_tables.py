"""Sites as a table: the same hits as by branches, and a plan that does not grow."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from catalogue.many_sites import generated_sites, shop_pages
from catalogue.rendered import mixed_pages
from speclake.operators.matching import RuleMatcher
from speclake.operators.page import page_of
from speclake.operators.parse import parse_pages
from speclake.operators.selectors import SELECTOR, as_data
from speclake.operators.site_data import BY_DATA, _rule_index, specs_as_data
from speclake.plans import extraction, site_tables
from speclake.sources.sites import Sites, load_sites

FOLDER = "/root/testdata/sf0.001"

PAGES = {
    "a": "<body><div id=x class='a b'><p class=a>K: v</p><ul class=b><li>one\ntwo<li class=c>three</ul></div></body>",
    "b": "<h2>H</h2><table class='t a'><tr class=skip><td>k</td><td>v</td></tr><tr><td>k2<td>v2<td>v3</table>"
    "<a href='/x.pdf'>Datasheet</a><a href=' /y'>y</a><a class=b>z</a>",
    "c": "<dl><dt>A<dd>1</dd></dl><h3>skip me</h3><h3 class=b>Real</h3><ul><li>k|<b>v</b><li>only</ul>"
    "<div class=row><b>n</b><i>1</i><i></i><i>2</i></div><div class=row><b></b><i>3</i></div>",
    "d": "<meta name=description content=' about '><div><div class=a><div class='b c' data-z=q1><p>deep</p></div></div></div>",
    "e": "",
}
RULES = [
    "p", ".a", "#x", "[data-z]", "[data-z='q1']", "[data-z*='1']", "[data-z^='q']", "[data-z$='q']", "[href*='']",
    "div p", "div > p", ".a > .b p", "div > div > .b", "body .b li", ".a .b > p", "div div, li", "li:not(.c)",
    "a:nth-of-type(2)", "#x > ul > li.c", "*", ".a > p, .b > li",
]
SPECS = [
    {"type": "table"},
    {"type": "table", "container": ".none", "tables": "table.t", "value_column": 2},
    {"type": "table", "skip_rows_with_class": "skip"},
    {"type": "dl", "container": "body"},
    {"type": "rows", "rows": ".row", "key": "b", "value": "i"},
    {"type": "rows", "rows": ".row", "key": "b", "value": "i", "multiple_values": True},
    {"type": "rows", "rows": ".row", "key": "", "value": "i"},
    {"type": "li_split"},
    {"type": "li_split", "split_on": "|", "skip_texts": ["SKIP me"], "section_headers": ["h3"]},
    {"type": "li_split", "min_parts": 1, "items": "ul > li"},
    {"type": "label_value"},
    {"type": "label_value", "pattern": "^(k)(.)$", "elements": ["td"]},
    {"type": "attribute", "selector": "a", "target_section": "S", "target_key": "K"},
    {"type": "attribute", "selector": "p", "attribute": "class"},
    {"type": "text", "selector": "div.row"},
    {"type": "meta_description"},
    {"type": "datasheet_link", "selectors": [".b", "a"], "base_url": "https://h.test/a/b"},
    {"type": "datasheet_link", "selectors": [".none"]},
    {"type": "datasheet_link"},
]


def frame(spark):
    return spark.createDataFrame(list(PAGES.items()), "name STRING, html STRING")


def test_selectors_as_data(spark):
    page = page_of()
    parsed = parse_pages(frame(spark)).withColumn("headings", F.array().cast("array<string>")).cache()
    rules = spark.createDataFrame([(i, as_data(r)) for i, r in enumerate(RULES)], f"i INT, rule {SELECTOR}")
    numbers = lambda nodes: F.transform(nodes, lambda n: n["pre"])
    by_data = parsed.crossJoin(rules).select("name", "i", numbers(page.select(F.col("rule"))).alias("found"))
    got = {(r.name, r.i): r.found for r in by_data.collect()}
    want = parsed.select("name", *[numbers(page.select(r)).alias(f"r{i}") for i, r in enumerate(RULES)]).collect()
    for row in want:
        for i, rule in enumerate(RULES):
            assert got[row.name, i] == row[f"r{i}"], (row.name, rule)
    assert sum(map(len, got.values())) > 60


def test_specs_as_data(spark):
    """One site per spec: hits by data equal those by branches, on every page."""
    sites = Sites({f"s{i}": {"name": f"N{i}", "specs": [spec]} for i, spec in enumerate(SPECS)})
    assert {s["type"] for s in SPECS} == set(BY_DATA) and not site_tables.own_groups(sites)
    pages = frame(spark).crossJoin(spark.range(len(SPECS)).select(F.concat(F.lit("s"), "id").alias("site")))
    both = [
        module.extract_pages(pages, sites, vendor=F.col("site")).select("name", "site", "hits", "vendor_name")
        for module in (extraction, site_tables)
    ]
    want, got = ({(r.name, r.site): (r.vendor_name, r.hits) for r in rows.collect()} for rows in both)
    assert got == want
    assert sum(len(hits) for _, hits in got.values()) > 15


def test_own_plans_are_dealt_by_group():
    sites = load_sites()
    twice = Sites({
        f"{s.vendor}{i}": {"name": s.name, "specs": list(s.specs)} for s in sites.all() for i in range(5)
    })
    assert len(site_tables.own_groups(twice)) == len(site_tables.own_groups(sites)) < len(sites.all())
    assert specs_as_data([{"type": "no such type"}]) is None
    assert specs_as_data([{"type": "attribute"}]) is None  # no selector
    assert specs_as_data([{"type": "rows", "rows": "a", "key": "b", "value": "i", "remove_noise": ["u"]}]) is None


@pytest.mark.parametrize("vendors", [None, "known"])
def test_built_in_sites(spark, vendors):
    pages = mixed_pages(spark, FOLDER).withColumn("more", F.lit(1))
    rows = [
        module.extract_pages(pages).select("p_partkey", "more", "vendor", "vendor_name", "canonical_url", "hits").collect()
        for module in (extraction, site_tables)
    ]
    assert sorted(map(repr, rows[0])) == sorted(map(repr, rows[1]))


def test_rules_of_all_kinds(spark):
    rng = random.Random(8)
    kinds = ("id", "class_contains", "text_contains", "selector", "other")
    args = ("x", "a", "b", "K: V", "deep", "div.a p", "p > b", "#x li", "", "li.c, h2")
    entries = {}
    for i in range(60):
        kind = rng.choice(kinds)
        arg = rng.choice([a for a in args if kind != "selector" or a and ":" not in a])
        entries[f"v{i}"] = {"priority": rng.choice([1, 5, None]), "detect": [{kind: arg}], "specs": []}
    for n in (0, 3, 60):
        sites = Sites(dict(list(entries.items())[60 - n :]))
        rows = [
            {r.name: r.vendor for r in module.extract_pages(frame(spark), sites, by_address=()).collect()}
            for module in (extraction, site_tables)
        ]
        assert rows[0] == rows[1]


def test_a_rule_is_tried_where_any_step_may_hold():
    """Ids and classes of outer steps tell pages apart, however common the last step's tag is."""
    rules = [(f"v{i}", "selector", f"div.box{i} > b[data-s='{i}']") for i in range(50)]
    rules += [("w", "selector", "#top em, p b"), ("x", "selector", "[data-z]")]
    matcher = RuleMatcher(_rule_index(rules))

    def tried(lists, ids, names):
        return [m["ord"] for m in matcher.candidates("", lists, ids, names)["maybe"]]

    assert tried(["a box3 c", "box7x", ""], [], ["div", "b"]) == [3, 50, 51]
    assert tried([""], ["top"], ["div", "em"]) == [50, 51]
    assert tried([""], [], ["em"]) == [51]


def test_plan_does_not_grow(spark):
    def built(many):
        sites, by_address = generated_sites(many)
        start = time.perf_counter()
        pages = site_tables.extract_pages(shop_pages(spark, FOLDER, many), sites, by_address=by_address)
        plan = pages._jdf.queryExecution().executedPlan().toString()
        return time.perf_counter() - start, len(re.sub(r"#\d+L?", "", plan)), plan

    built(5)
    few, many = built(10), built(1000)
    assert many[1] < 1.02 * few[1] + 200
    assert many[0] < few[0] + 3
    assert "BroadcastHashJoin" in many[2] and "SortMergeJoin" not in many[2] and "Cartesian" not in many[2]


def test_a_large_table_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(site_tables, "BROADCAST_BYTES", 10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = site_tables.extract_pages(mixed_pages(spark, FOLDER))
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.where("size(hits) > 0").count() == extraction.extract_pages(
            mixed_pages(spark, FOLDER)
        ).where("size(hits) > 0").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
