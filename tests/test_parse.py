"""The page tree: hand-made pages and properties of the given ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from speclake.operators.parse import decode_escaped, parse_pages, read_tree


def tags(page):
    return [(n[4], n[2], n[1]) for n in read_tree(page).nodes]


def test_unclosed_elements_nest():
    tree = read_tree("<p>a<p>b")
    assert [(n[4], n[2]) for n in tree.nodes] == [("p", -1), ("p", 0)]
    assert tree.texts == ["a", "b"] and tree.nodes[0][8:10] == [0, 2]


def test_end_tags():
    # An end tag closes its element and all inside it; others are ignored.
    assert tags("<div><b><i></div></u><p></p>") == [
        ("div", -1, 2), ("b", 0, 2), ("i", 1, 2), ("p", -1, 3)
    ]


def test_void_and_self_closed():
    assert tags("<br>x<img/><p/>y<hr></hr>") == [
        ("br", -1, 0), ("img", -1, 1), ("p", -1, 2), ("hr", -1, 3)
    ]


def test_attributes():
    node = read_tree("<A HREF='x&amp;y' b class=' p  q ' href=z disabled>").nodes[0]
    assert node[4] == "a"
    assert node[5] == {"href": "z", "b": "", "class": " p  q ", "disabled": ""}
    assert node[6] == ["p", "q"]


def test_nth_of_type():
    nodes = read_tree("<div><b></b><i></i><b></b></div><b></b>").nodes
    assert [(n[4], n[7]) for n in nodes] == [
        ("div", 1), ("b", 1), ("i", 1), ("b", 2), ("b", 1)
    ]


def test_texts():
    tree = read_tree(
        "a&amp;b<!-- no -->c &#233;&unknown;&nbsp;<script>no <b></script><style>no</style>"
        "<template>no</template><ruby>r<rt>no</rt></ruby>  \n <pre> \n </pre>"
    )
    assert tree.texts == ["a&b", "c \xe9&unknown\xa0", "r", "\n", " \n "]
    assert tree.scripts == [(0, None, "no <b>")]


def test_templates_with_text():
    tree = read_tree(
        "<template>&lt;b&gt;1&lt;/b&gt;</template><template><i>&lt;u></i></template>"
        "<template>x<b></b></template><template> <p>&lt;b></p></template><template>plain</template>"
    )
    assert list(tree.text_templates()) == [(0, "<b>1</b>"), (1, "<u>")]


def test_positions():
    page = "<div\n id=a>x<p>y</p>\n<br>z</div>tail<i>u"
    tree = read_tree(page, positions=True)
    parts = [(page[s:e], page[a:b]) for s, a, b, e in tree.spans]
    assert parts == [
        ("<div\n id=a>x<p>y</p>\n<br>z</div>", "x<p>y</p>\n<br>z"),
        ("<p>y</p>", "y"),
        ("<br>", ""),
        ("<i>u", "u"),
    ]


def test_decode():
    # As a string literal, but what is not escaped stays.
    page = "\\x3Cp a=\\\"b\\\"\\x3E\xe9\\u0041\\n\\101\\\\n\\d\\x3\\uD800\\" + "\n!"
    assert decode_escaped(page) == '<p a="b">\xe9A\nA\\n\\d\\x3\ufffd!'
    plain = "\\x3Cb c=\\'\\\"\\' \\t\\x41\\u00e9\\U0001F600\\0\\18\\v"
    assert decode_escaped(plain) == plain.encode().decode("unicode-escape")
    late = "x" * 1000 + "\\x3C"
    assert decode_escaped(late) == late
    assert decode_escaped("&lt;p&gt;&amp;amp;") == "<p>&amp;"
    assert decode_escaped("\\x3c") == "\\x3c"


@pytest.fixture(scope="module")
def parsed(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    return parse_pages(pages)


def test_tree_properties(parsed):
    nodes = parsed.select("page_id", F.explode("nodes").alias("n"), "nodes")
    parent = F.get("nodes", F.col("n.parent"))
    bad = nodes.where(
        (F.col("n.pre") > F.col("n.last"))
        | (F.col("n.t0") > F.col("n.t1"))
        | (
            (F.col("n.parent") >= 0)
            & (
                (parent["pre"] >= F.col("n.pre"))
                | (parent["last"] < F.col("n.last"))
                | (parent["depth"] + 1 != F.col("n.depth"))
                | (parent["t0"] > F.col("n.t0"))
                | (parent["t1"] < F.col("n.t1"))
            )
        )
        | (F.get("nodes", F.col("n.pre"))["pre"] != F.col("n.pre"))
    )
    assert nodes.count() > 1000 and bad.count() == 0


def test_same_in_one_and_many_partitions(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    digests = [
        parse_pages(pages.repartition(n, "page_id"))
        .select("page_id", F.sha2(F.to_json(F.struct("nodes", "texts")), 256).alias("d"))
        .orderBy("page_id")
        .collect()
        for n in (1, 8)
    ]
    assert digests[0] == digests[1]


def test_null_page_and_large_batches(spark):
    rows = [(1, None), (2, "<p>x</p>" * 1000)] * 600
    frame = spark.createDataFrame(rows, "page_id INT, html STRING").coalesce(1)
    sizes = parse_pages(frame).groupBy("page_id").agg(
        F.sum(F.size("nodes")).alias("n"), F.count("error").alias("errors")
    )
    assert sorted(map(tuple, sizes.collect())) == [(1, 0, 0), (2, 600_000, 0)]


def state(tree):
    return tree.nodes, tree.texts, tree.scripts, list(tree.text_templates())


def slow_tree(page):
    from speclake.operators.parse import _Tree

    tree = _Tree()
    tree.feed(page)
    tree.finish()
    return tree


PIECES = [
    "<p>", "</p>", "<P class=' a  b '>", "<a href='x&amp;y' B>", "<a href=/p/1?x=1&y=2>", "</a >",
    "<br>", "<br/>", "</br>", "<img src=x/>", "<i/>", "<i x=\"1\"/>", "<div\n id=d\n>", "</div>",
    "<script>", "<script type='t'>if (a<b) x='</p>' & y</script>", "</script>", "<style>p{}</style>",
    "<SCRIPT>x</Script>", "<script>x</script >", "<template>", "</template>", "&lt;b>", "&#233;",
    "&#x1F600;", "&#128;", "&#129;", "&#55296;", "&nbsp;", "&notit;", "&nope;", "&amp", "& ", "&",
    "&#;", "&#x;", "text", "  \n ", " ", "<!-- c -->", "<!---->", "<!-->", "<!-- a--b -->",
    "<!-- x - - -->", "<!DOCTYPE html>", "<!doctype x>", "<?pi x>", "<![CDATA[x]]>", "< b", "<",
    "a > b", "<x-y:z.w>", "</x-y:z.w>", "<a b = c>", "<a b='c'd>", "<a 'q'>", "<pre> \n ", "</pre>",
    "<a é=ü>", "é", "<textarea>", "<rt>", "</rt>", "</ p>", "</p x>", "<a/b>", "<p\x00>",
]


def test_regular_reading_equals_the_full_parser():
    import random

    random.seed(3)
    regular = 0
    for _ in range(20_000):
        page = "".join(random.choices(PIECES, k=random.randint(1, 9)))
        from speclake.operators.parse import _Tree

        fast = _Tree()
        if fast.read_regular(page):
            regular += 1
            assert state(fast) == state(slow_tree(page)), page
    assert regular > 2000


def test_given_pages_are_regular():
    import pyarrow.parquet as pq

    from speclake.operators.parse import _Tree

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist()
    for page in pages:
        fast = _Tree()
        assert fast.read_regular(page)
        assert state(fast) == state(slow_tree(page))


def test_pages_of_one_shape_share_a_tree(monkeypatch):
    """Tags and texts are put into the tree of the page's shape, which is built once."""
    from speclake.operators import parse

    built = []
    own = parse._Tree.__init__
    monkeypatch.setattr(parse._Tree, "__init__", lambda self, *a: (built.append(1), own(self, *a))[1])
    pages = [
        f'<div class="a {"b" * (i % 3)}" id=n{i}><p>x{i} &amp; y</p> \n <br><pre> \n</pre>'
        f"<template>&lt;b&gt;{i}&lt;/b&gt;</template></div>{'z' * (i % 2)}"
        for i in range(60)
    ]
    out, shapes = parse._PageColumns, parse._Shapes()
    fast = out(shapes, window=0)
    for page in pages:
        fast.add(page, ())
    # Texts at the end or none, one class or two, and the template's own page.
    assert len(built) == 5
    slow = out(parse._Shapes(), window=0)
    monkeypatch.setattr(slow.shapes, "read", lambda page: None)
    for page in pages:
        slow.add(page, ())
    names = list(parse.TREE_COLUMNS)
    for a, b in zip(fast.arrays(names), slow.arrays(names), strict=True):
        assert a.to_pylist() == b.to_pylist()


@pytest.mark.parametrize("page", [
    "<p>a <b", "<a t='x > y'>1</a>", '<a t="x < y">1</a>', "<!-- <b>1</b> -->", "<!-- a > b -->1", "a < b<i>1</i>",
    "<script>1</script>", "<style>p</style>", "<a b='c'd>1</a>", "</p x><i>1</i>", "<i>&amp</i>", "<p/ >", "x",
    "<template><!-- &lt; --></template>",
])
def test_pages_without_a_shape(page):
    from speclake.operators.parse import _Shapes, read_page

    tree, want = read_page(page, _Shapes()), read_tree(page)
    assert (tree.nodes, tree.texts, tree.scripts) == (want.nodes, want.texts, want.scripts)
