"""Hand-made pages for semantics that are easy to get wrong."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from speclake.operators.classify import site_of_page
from speclake.operators.page import page_of
from speclake.plans import assemble, extraction
from speclake.sources.sites import Sites, load_sites


def test_label_lines(extract):
    found = extract({"type": "label_value"}, {
        "greedy key": "<p>ab: b: c</p>",
        "short key": "<p>k: v</p>",
        "nested twice": "<h2>B</h2><div><p>Type: x</p></div>",
        "no-break space": "<p>Size:&nbsp;&nbsp;5</p>",
        "long value": "<p>Size: " + "x" * 201 + "</p>",
        "script": "<div><script>xx: y</script></div>",
    })
    assert found["greedy key"] == [("Unknown", "ab: b", "c")]
    assert found["short key"] == []
    assert found["nested twice"] == [("B", "Type", "x")] * 2
    assert found["no-break space"] == [("Unknown", "Size", "5")]
    assert found["long value"] == [] and found["script"] == []


def test_long_texts_are_told_apart(extract):
    """The shortcut for long texts changes nothing: same hits as without it."""
    import random

    random.seed(5)
    bits = ["a", "bc ", ": ", " ", "&nbsp;", "\\t", "x" * 60, "<b>y</b>", "<p>", "</p>", "<div>",
            "</div>", "&lt;!-- ", " -->", "\n", "<i>:</i>", "long " * 30]
    pages = {
        str(i): "<div>" + "".join(random.choices(bits, k=random.randint(2, 25)))
        for i in range(400)
    }
    quick = extract({"type": "label_value"}, pages)
    plain = extract({"type": "label_value", "pattern": r"^(.{2,80}):\s*(.{1,200})(?:)$"}, pages)
    assert quick == plain and sum(map(len, quick.values())) > 100


def test_definition_lists(extract):
    found = extract({"type": "dl", "container": ".nope"}, {
        "shifted": "<dl><dt>A</dt><dd>1</dd><dd>2</dd><dt>B</dt><dd>3</dd></dl>",
        "heading around": "<h2>Spec <dl><dt>A</dt><dd>1</dd></dl></h2>",
        "blank heading": "<h2>A</h2><h3> &nbsp;</h3><dl><dt>k</dt><dd>v</dd></dl>",
        "blank pair": "<dl><dt> </dt><dd>1</dd><dt>B</dt><dd>2</dd></dl>",
        "nested": "<dl><dt>A</dt><dd>x<dl><dt>B</dt><dd>y</dd></dl></dd></dl>",
    })
    assert found["shifted"] == [("Unknown", "A", "1"), ("Unknown", "B", "2")]
    assert found["heading around"] == [("Spec A 1", "A", "1")]
    assert found["blank heading"] == [("A", "k", "v")]
    assert found["blank pair"] == [("Unknown", "B", "2")]
    assert found["nested"] == [
        ("Unknown", "A", "x B y"), ("Unknown", "B", "y"), ("Unknown", "B", "y")
    ]


def test_tables(extract):
    found = extract(
        {"type": "table", "tables": "table", "key_column": 1, "value_column": 2,
         "skip_rows_with_class": "hc"},
        {
            "columns": "<h1>T</h1><table><tr><td>a</td><td>b</td><td>c\\td</td></tr></table>",
            "too few": "<table><tr><td>a</td><td>b</td></tr></table>",
            "token only": "<table><tr class='hcx'><td>a<td>b</td><td>c</td></td></tr>"
                          "<tr class='x hc'><td>a</td><td>b</td><td>c</td></tr></table>",
        },
    )
    assert found["columns"] == [("T", "b", "c d")]
    assert found["too few"] == []
    assert found["token only"] == [("Unknown", "b", "c")]


def test_rows(extract):
    spec = {"type": "rows", "rows": ".r", "key": ".k", "value": "li, b.v", "multiple_values": True,
            "remove_noise": [".n", "i"]}
    found = extract([spec, {"type": "text", "selector": ".n", "target_key": "Later"},
                     {"type": "text", "selector": ".r", "target_key": "Row"}], {
        "noise": "<p class=n>kept</p><div class=r><b class=k>K<i>!</i></b><li>1<i class=n>mm</i>"
                 "</li><li><i>x</i></li><b class=v>2</b><li class=n>3</li></div>",
        "no key": "<div class=r><li>1<i>u</i></li></div>",
    })
    assert found["noise"] == [
        ("Unknown", "K !", "1 | 2"), ("General", "Later", "kept"), ("General", "Row", "K 1 2"),
    ]
    # Without a key nothing is taken out.
    assert found["no key"] == [("General", "Row", "1 u")]


def test_list_split(extract):
    found = extract(
        {"type": "li_split", "container": "#c", "skip_texts": ["Technical Data"], "min_parts": 3},
        {
            "skip": "<h3>Out</h3><div id=c><h3>A</h3><h4>TECHNICAL data</h4>"
                    "<li>k<b>v</b>\nw</li><li>a<b>b</b></li></div>",
            "before any": "<div id=c><li><i>a</i><i>b</i><i>c</i></li></div>",
        },
    )
    assert found["skip"] == [("A", "k", "v w")]
    assert found["before any"] == [("Unknown", "a", "b c")]


def test_list_split_below_other_headers(extract):
    found = extract({"type": "li_split", "section_headers": ["h2", "caption"]}, {
        "p": "<h2>A</h2><li><b>a</b>1</li><caption>B</caption><h3>no</h3><li><b>b</b>2</li>",
    })
    assert found["p"] == [("A", "a", "1"), ("B", "b", "2")]


def test_first_match(extract):
    found = extract(
        [
            {"type": "attribute", "selector": "img.x", "attribute": "src"},
            {"type": "image", "selector": "img.x", "target_section": "I"},
            {"type": "meta_description"},
        ],
        {
            "lacks": "<img class=x><img class=x src=a>",
            "blank": "<meta name=description content=' '><meta name=description content=b>",
        },
    )
    assert found["lacks"] == [("I", "Image URL", "a")]
    assert found["blank"] == []


def test_datasheet_order(extract):
    found = extract({"type": "datasheet_link", "selectors": ["a.one", "a.two"]}, {
        "selector order": "<a class=two href=t.pdf>x</a><a class=one href=o.PDF>x</a>",
        "keeps looking": "<a class=one>x</a><a class=one href=x.html><a class=one href=d.pdf>",
        "text": "<a href=a.pdf>other</a><a href=b.pdf>Das <b>Datenblatt</b></a>",
        "text must pass": "<a href=b.html>Datenblatt</a>",
    })
    assert [found[k][0][2] if found[k] else None for k in found] == [
        "o.PDF", "d.pdf", "b.pdf", None
    ]


def test_variants(extract):
    import json

    fields = {"item_reference": ".ref", "ref": ".short", "title": "b", "url": "a",
              "list_price": ".lp", "your_price": ".yp",
              "specs": {"rows": ".s", "key": "i", "value": ".s"}}
    spec = {"type": "product_variants", "variant_selector": ".card", "fields": fields}
    found = extract(spec, {
        "reference": "<div class=card><i class=short>S</i></div><div class=card><i class=ref>R</i>"
                     "<i class=short>S</i><a>no href</a></div>",
        "prices": "<div class=card><u class=lp>9.058,00 EUR /</u><u class=yp> </u></div>",
        "first lacks": "<div class=card><b> </b><a>x</a><a href=y>y</a></div>",
        # The value selector is looked for below the row, which is itself.
        "nested specs": "<div class=card><b>t</b><p class=s><i>k</i>v</p></div>",
    })

    def records(name):
        return json.loads(found[name][0][2]) if found[name] else []

    assert records("reference") == [{"item_reference": "R"}]
    assert records("prices") == [{"list_price": "9.058,00 EUR"}]
    assert records("first lacks") == [{"title": ""}]
    assert records("nested specs") == [{"title": "t"}]


def test_script_model(extract):
    spec = load_sites().spec_source("abb").specs[0]
    group = '{"attributes":{"A":{"values":["%s"]},"DatSheTecInf":{"values":[{"link":{"documentId":"%s"}}]}},"visible":%s}'
    model = '<script>var model={"name":"m","attributeGroups":{"items":[%s]}};</script>'
    found = extract(spec, {
        "cut": '<script>var model = {"sku":"1","x":"};"};</script>'
               '<script type="application/ld+json">{"@type":"Product","name":"n"}</script>',
        "structured wins": model % "" +
               '<script type="application/ld+json">{"@type":"Product","name":"n"}</script>'
               '<script type="application/ld+json">[{"@type":"Product","name":"list"}]</script>',
        "hidden": model % (group % ("a", "D", "false")),
        "two sheets": model % (group % ("a", "D1", "true") + "," + group % ("b", "D2", "1")),
        "mended": "<script>var model = {\\\"sku\\\":\\\"7\\\"};</script>",
        "trailing": '<script type="application/ld+json">{"@type":"Product","sku":"1"};</script>',
    })
    info = "Product Info"
    assert found["cut"] == [(info, "Product Name", "n")]
    assert found["structured wins"] == [(info, "Product Name", "n")]
    assert found["hidden"] == [(info, "Product Name", "m")]
    assert [h for h in found["two sheets"] if h[1] == "Datasheet PDF"] == [
        (info, "Datasheet PDF",
         "https://search.abb.com/library/Download.aspx?DocumentID=D1&LanguageCode=en"
         "&DocumentPartId=&Action=Launch")
    ]
    assert [h[2] for h in found["two sheets"] if h[1] == "A"] == ["a", "b"]
    assert found["mended"] == [(info, "Product ID", "7")]
    assert found["trailing"] == []


def test_structured_image_depth(extract):
    spec = {"type": "image", "selector": "img.none", "fallback_jsonld": True}
    page = '<script type="application/ld+json">%s</script>'
    found = extract(spec, {
        "depth first": page % '{"z":{"q":[{"image":"deep"}]},"a":{"image":"shallow"}}',
        "very deep": page % ('{"a":[' * 30 + '{"image":{"url":"x"}}' + "]}" * 30),
        "second script": page % '{"image":""}' + page % '{"image":["u"]}',
        "empty object ends": page % '{"image":{},"b":{"image":"no"}}',
    })
    assert [found[k][0][2] if found[k] else None for k in found] == ["deep", "x", "u", None]


SITES = {
    "first": {"priority": 10, "detect": [{"id": "spec"}]},
    "second": {"priority": 35, "detect": [{"class_contains": "title"}]},
    "bare": {"detect": [{"selector": "p.q i:nth-of-type(2)"}, {"text_contains": "BIG Word"}]},
    "none": {"priority": 1, "detect": None},
}


@pytest.mark.parametrize(("page", "site"), [
    ('<link rel=canonical href="https://HOUSE.com/x"><i id=spec>', "schneider"),
    ("<link rel=canonical><link rel=canonical href='http://vega.com'><i id=spec>", "first"),
    ("<b class='a-title-b'></b><i id=spec>", "first"),
    ("<b class='a-title-b'></b>big word", "second"),
    ("<p>a big <b>wo</b>rd", "bare"),
    ("<p class=q><i></i><u><i></i><i></i></u></p>", "bare"),
    ("<script>big word</script>", "generic"),
])
def test_sites(spark, page, site):
    frame = spark.createDataFrame([(page,)], "html STRING")
    trees = extraction.read_trees(frame)
    assert trees.select(site_of_page(page_of(), Sites(SITES))).first()[0] == site


def test_documents(spark):
    pages = spark.createDataFrame([(1, "<b></b><i v=2></i><dl><dt>a</dt><dd>x</dd></dl>")],
                                  "page_id INT, html STRING")
    sites = Sites({"generic": {"name": "Any", "specs": [
        {"type": "schneider_json", "json_selector": "b", "json_attribute": "none"},
        {"type": "dl"},
        {"type": "attribute", "selector": "i", "attribute": "v", "target_section": "Unknown",
         "target_key": "a"},
    ]}})
    document = extraction.extract_documents(pages, sites, vendor=F.lit("generic")).first()
    assert document.kv == {"Unknown": {"a": "2"}}
    assert document.stats == {"dl": 1, "attribute": 1}
    assert document.metadata.canonical_url is None
    assert document.file_name.endswith("_unknown_url.json")


def test_empty_section_stays(spark):
    # A label that is only tags is written as '' and dropped in cleanup.
    page = ("<div plain-all-data='{\"specifications\":{\"characteristicTables\":[{\"tableName\":\"T\","
            "\"rows\":[{\"characteristicName\":\"k\",\"characteristicValues\":[{\"labelText\":"
            "\"<br>\"}]}]}]}}'></div>")
    sites = Sites({"generic": {"specs": [load_sites().spec_source("schneider").specs[0]]}})
    frame = spark.createDataFrame([(1, page)], "page_id INT, html STRING")
    extracted = extraction.extract_pages(frame, sites, vendor=F.lit("generic"))
    document = assemble.documents_from_hits(extracted, ["page_id"]).first()
    assert document.kv == {"T": {}} and document.stats == {"schneider_json": 1}
    assert assemble.kv_from_hits(extracted, ["page_id"]).count() == 0


def test_unknown_operator_is_skipped(extract):
    with pytest.warns(UserWarning, match="nonsense"):
        found = extract([{"type": "nonsense"}, {"type": "dl"}],
                        {"p": "<dl><dt>a</dt><dd>b</dd></dl>"})
    assert found["p"] == [("Unknown", "a", "b")]


def test_own_operator(extract):
    from speclake.operators.hits import hit
    from speclake.operators.registry import OPERATORS, register

    def title_case(page, spec, context):
        return F.transform(
            page.select(spec["selector"]),
            lambda e: hit(F.lit(context.site_name), F.lit("Own"), F.initcap(page.text(e))),
        )

    register("title_case", title_case)
    try:
        found = extract({"type": "title_case", "selector": "h1"}, {"p": "<h1>two words</h1>"}, "S")
    finally:
        del OPERATORS["title_case"]
    assert found["p"] == [("S", "Own", "Two Words")]


def _tree(rng, depth=0):
    """A random tree: [tag, class, children], a child may be a text."""
    tag, name = rng.choice([("div", "r"), ("div", "r"), ("b", ""), ("u", ""), ("i", ""), ("p", "n"), ("p", "")])
    children = [f"t{rng.randint(0, 99)} " if rng.random() < 0.7 else ""]
    if depth < 5 and tag in ("div", "p"):
        for _ in range(rng.randint(0, 4)):
            children += [_tree(rng, depth + 1), f"x{rng.randint(0, 9)} " if rng.random() < 0.3 else ""]
    return [tag, name, children]


def _markup(node):
    if isinstance(node, str):
        return node
    tag, name, children = node
    return f"<{tag} class='{name}'>" + "".join(map(_markup, children)) + f"</{tag}>"


def _all(node):
    for child in node[2]:
        if not isinstance(child, str):
            yield child
            yield from _all(child)


def _content(node):
    return " ".join("".join(_markup(c) if isinstance(c, str) else f" {_content(c)} " for c in node[2]).split())


def _mutating(root):
    """Rows read one after the other from a tree that loses their noise."""
    out = []
    for row in [n for n in _all(root) if n[:2] == ["div", "r"]]:
        key = next((n for n in _all(row) if n[0] == "b"), None)
        label = _content(key) if key else ""
        if not label:
            continue
        for noise in [n for n in _all(row) if n[0] == "i" or n[1] == "n"]:
            for x in [noise, *_all(noise)]:
                x[2] = []  # gone with all that is in it

        def drop(node):
            node[2] = [c for c in node[2] if isinstance(c, str) or not (c[0] == "i" or c[1] == "n")]
            for c in node[2]:
                if not isinstance(c, str):
                    drop(c)

        drop(row)
        value = next((n for n in _all(row) if n[0] == "u"), None)
        if value and _content(value):
            out.append(("Unknown", label, _content(value)))
    return out


def test_noise_of_outer_rows_is_gone_for_nested_ones(extract):
    rng = random.Random(21)
    spec = {"type": "rows", "rows": "div.r", "key": "b", "value": "u", "remove_noise": ["i", ".n"]}
    trees = {f"p{i}": ["body", "", [_tree(rng) for _ in range(3)]] for i in range(150)}
    pages = {name: _markup(tree) for name, tree in trees.items()}
    found = extract(spec, pages)
    want = {name: _mutating(tree) for name, tree in trees.items()}
    assert {name: found[name] for name in want} == want
    assert sum(map(len, want.values())) > 60
