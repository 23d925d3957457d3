"""Rules that a config or a page can put to the test, one by one."""

from __future__ import annotations

import json
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from speclake.functions.urls import absolute_url
from speclake.operators import listing
from speclake.operators.page import page_of
from speclake.operators.parse import parse_pages
from speclake.operators.registry import failed_specs
from speclake.plans import extraction, fragments
from speclake.sources.sites import Sites


def model(attribute, **group):
    group = {"description": "G", "attributes": {"A": attribute}} | group
    text = json.dumps({"attributeGroups": {"items": [group]}})
    return f"<script>var model = {text};</script>"


def test_attribute_values_by_kind(extract):
    spec = {"type": "abb_json", "extract": {"specifications": {}}}
    pages = {
        "empty first": model({"values": ["", "a"]}),
        "number": model({"values": [5]}),
        "zero text": model({"values": [{"text": 0}]}),
        "number text": model({"values": [{"text": 7}, {"text": "x"}]}),
        "brace": model({"values": ["{x"]}),
        "string flag": model({"values": ["a"]}, visible="false"),
        "hidden": model({"values": ["a"]}, visible=False),
        "null": model({"values": ["a"]}, visible=None),
        "internal": model({"values": ["a"], "isInternal": "no"}),
        "named": model({"values": ["a"], "attributeName": "N"}),
    }
    found = extract(spec, pages)
    assert found["empty first"] == [("G", "A", " / a")]
    assert found["number"] == found["zero text"] == found["hidden"] == found["null"] == []
    assert found["number text"] == [("G", "A", "7 / x")]
    assert found["brace"] == [("G", "A", "{x")]
    assert found["string flag"] == [("G", "A", "a")]
    assert found["internal"] == []
    assert found["named"] == [("G", "N", "a")]


@pytest.mark.filterwarnings("ignore:spec .* skipped", "ignore:unknown operator")
def test_a_spec_that_cannot_be_used_costs_only_itself(extract, spark):
    specs = [
        {"type": "text", "selector": "p ~ b", "target_section": "S", "target_key": "K"},
        {"type": "attribute", "attribute": "x", "target_section": "S", "target_key": "A"},
        {"type": "label_value", "pattern": "(unclosed"},
        {"type": "nothing of the kind"},
        {"type": "text", "selector": "b", "target_section": "S", "target_key": "B"},
    ]
    found = extract(specs, {"p": "<b>x</b>"})
    assert found["p"] == [("S", "B", "x")]
    failed = failed_specs(Sites({"any": {"specs": specs}}))
    assert [(vendor, at) for vendor, at, *_ in failed] == [("any", i) for i in range(4)]


def test_child_selectors_and_attribute_ends(extract):
    page = (
        "<div class=a><p><b>1</b></p></div><div class=a><i><p><b>2</b></p></i></div>"
        "<ul><li><a href='/x.pdf'>3</a></li></ul><a href='/pdf/y'>4</a>"
    )
    rules = {
        "div.a > p b": "1", "div.a p > b": "1", "i > p > b": "2", "div > i b": "2", "ul > a": None,
        "li>a": "3", "[href$='.pdf']": "3", "[href ^= '/pdf']": "4", "a[href^='']": None,
    }
    specs = [
        {"type": "text", "selector": rule, "target_section": "S", "target_key": rule} for rule in rules
    ]
    found = extract(specs, {"p": page})["p"]
    assert {k: v for _, k, v in found} == {k: v for k, v in rules.items() if v}


def test_child_chains_equal_a_plain_walk(spark):
    rng = random.Random(4)
    pages = []
    for _ in range(20):
        text, stack = "", []
        for _ in range(40):
            if stack and rng.random() < 0.4:
                text += f"</{stack.pop()}>"
            else:
                stack.append(rng.choice(["div", "span", "b"]))
                text += f"<{stack[-1]}>"
        pages.append(text + "".join(f"</{t}>" for t in reversed(stack)))
    rules = ["div > span b", "div span > b", "div > div > span", "b > div span > b div"]
    frame = spark.createDataFrame(list(enumerate(pages)), "id INT, html STRING")
    page = page_of()
    rows = parse_pages(frame, want=("nodes",)).select(
        "nodes", F.array(*[F.transform(page.select(r), lambda n: n["pre"]) for r in rules]).alias("hits")
    ).collect()

    def met(nodes, at, steps):
        """steps: (tag, child) from the last to the first."""
        if not steps:
            return True
        up = nodes[at]["parent"]
        (tag, _), child = steps[0], steps[0][1]
        while 0 <= up < len(nodes):
            if nodes[up]["tag"] == tag and met(nodes, up, [*steps[1:]]):
                return True
            if child:
                return False
            up = nodes[up]["parent"]
        return False

    for row in rows:
        nodes = [n.asDict() for n in row.nodes]
        for rule, hits in zip(rules, row.hits, strict=True):
            parts = rule.replace(" > ", " >").split(" ")
            tags = [p.lstrip(">") for p in parts]
            # A step's mark tells how its own outer step must stand.
            marks = [p.startswith(">") for p in parts]
            steps = [(tags[i], marks[i + 1]) for i in range(len(parts) - 2, -1, -1)]
            want = [
                i for i, n in enumerate(nodes) if n["tag"] == tags[-1] and met(nodes, i, steps)
            ]
            assert hits == want, rule


def test_relative_addresses_as_in_a_browser(spark):
    bases = [
        "https://h.test", "https://h.test/", "https://h.test/cat/page", "https://h.test/cat/page?x=1#y",
        "https://h.test/a/b/",
    ]
    links = [
        "a", "/a", "../a", "/../x", "a/../b", "./a/./b/..", "..", "?q=../1", "#f", "", "//o.test/x/../y",
        "http://z.test/a", "mailto:x@y", "a?b/../c", "x/..y/z.", "../../../q/",
    ]
    frame = spark.createDataFrame([(u,) for u in links], "u STRING")
    for base in bases:
        rows = frame.select("u", absolute_url(F.col("u"), base).alias("v")).collect()
        assert {r.u: r.v for r in rows} == {u: urljoin(base, u) for u in links}


def test_template_text_by_any_selector(extract):
    page = (
        "<div class=card><b>t</b><template>&lt;p&gt;&lt;i class=n&gt;no&lt;/i&gt;&lt;/p&gt;</template>"
        "<template>&lt;u&gt;&lt;p&gt;&lt;i class=n&gt;9 EUR&lt;/i&gt;&lt;/p&gt;&lt;/u&gt;</template></div>"
    )
    spec = {
        "type": "product_variants", "variant_selector": "div.card",
        "fields": {"title": "b", "your_price": "u p > i.n"},
    }
    found = extract(spec, {"p": "<body>" + " " * 1000 + page})["p"]
    assert json.loads(found[0][2])[0]["your_price"] == "9 EUR"


def test_closing_by_the_least_number(spark):
    rows = [(1, 5, "<html><body>a</body></html>"), (1, 6, "b</body></html>"), (2, 0, "<body>c</body>")]
    frame = spark.createDataFrame(rows, "k INT, frag_no INT, html STRING")
    found = sorted(tuple(r) for r in listing.closed_parts(frame, ["k"]).fillna(99).collect())
    assert found == [
        (1, 1, 5, "<html><body>a"), (1, 1, 6, "b</body></html>"), (1, 2, 99, "</body></html>"),
        (2, 1, 0, "<body>c"), (2, 2, 99, "</body></html>"),
    ]


def test_first_match_types_over_fragments(spark):
    """JSON, cards and PDF links: the merged page takes the first, so do fragments."""

    def plain(key):
        return json.dumps({"base": {"productId": key}}).replace('"', "&quot;")

    parts = [f'<div plain-all-data="{plain(key)}"></div>' for key in ("1", "2")]
    sites = Sites({"generic": {"specs": [{
        "type": "schneider_json", "json_selector": "[plain-all-data]",
        "json_attribute": "plain-all-data", "extract": {"product_id": {"path": "base.productId"}},
    }]}})
    frame = spark.createDataFrame(
        [(1, i, p) for i, p in enumerate(parts)], "page INT, frag_no INT, html STRING"
    )
    pieces = fragments.extract_fragments(frame, F.lit("generic"), ["page"], sites)
    got = [(r.section, r.key, r.value) for r in fragments.fragment_kv(pieces, ["page"]).collect()]
    merged = spark.createDataFrame([(1, "".join(parts))], "page INT, html STRING")
    kv = extraction.extract_documents(merged, sites, vendor=F.lit("generic")).first().kv
    assert got == [(s, k, v) for s, entries in kv.items() for k, v in entries.items()]


def test_listing_has_facts_and_items(spark):
    """Facts and list of a listing in one result, as on the merged page."""
    def card(n):
        return f'<div class=card><b>T "{n}", é</b><i>R{n}</i></div>'

    parts = [
        "<p>Size: 1</p>" + card(1) + card(2), "<dl><dt>d</dt><dd>1</dd></dl>",
        card(3) + "<p>Size: 2</p>", card(4),
    ]
    first = {"type": "product_variants", "variant_selector": "div.card", "fields": {"title": "i"}}
    second = first | {"fields": {"title": "b", "ref": "i"}}
    fact = {"type": "text", "selector": "dd", "target_section": "Product Variants", "target_key": "Items"}
    for specs in ([{"type": "dl"}, first, second, {"type": "label_value"}], [first, fact], [fact, first]):
        sites = Sites({"generic": {"specs": specs}})
        frame = spark.createDataFrame(
            [(k, i, p) for k in (1, None) for i, p in enumerate(parts)],
            "page INT, frag_no INT, html STRING",
        )
        pieces = fragments.extract_fragments(frame, F.lit("generic"), ["page"], sites)
        rows = fragments.fragment_listing(pieces, ["page"]).collect()
        merged = spark.createDataFrame([(1, "".join(parts))], "page INT, html STRING")
        kv = extraction.extract_documents(merged, sites, vendor=F.lit("generic")).first().kv
        want = {(s, k): v for s, entries in kv.items() for k, v in entries.items()}
        for page in (1, None):
            own = [r for r in rows if r.page == page]
            got = {(r.section, r.key): r.value for r in own if r.item_no is None}
            items = sorted((r.frag_no, r.item_no, r.value) for r in own if r.item_no is not None)
            if items:
                got["Product Variants", "Items"] = f"[{','.join(v for *_, v in items)}]"
            assert got == want
