"""Cards found by the parse against ``variant_records`` on the page tree."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from speclake.functions.text import SPACE
from speclake.functions.text import clean_text as clean_column
from speclake.functions.urls import absolute_url
from speclake.operators import cards as found
from speclake.operators import parse
from speclake.operators.parse import parse_pages
from speclake.plans.variants import variant_rows

SPEC = {
    "container": "main .list", "variant_selector": "article.card, li > div.card", "base_url": "https://h.test/a/b",
    "fields": {
        "title": "h3 span, h4", "item_reference": ".ref", "ref": "u", "url": "a[href]", "description": "p:not(.no)",
        "image": "div.pic > img", "list_price": "b.price", "your_price": "i:nth-of-type(2), .own",
        "availability": "[data-s^='av']", "specs": {"rows": "tr", "key": "th", "value": "td"},
    },
}
BARE = {"variant_selector": "#c", "fields": {"your_price": ".own", "ref": "b[x='1&2']", "url": "a"}}
ONLY_SPECS = {"container": "", "variant_selector": "div", "fields": {"specs": {"rows": "p", "key": "b", "value": "i"}}}

PIECES = [
    '<main><div class="list x">', "<div class=list>", "</main>", '<article class="card y">', "</article>",
    "<li><div class='card'>", '<div class="card">', "</div>", "</li>", "<h3><span>T{n} </span>", "</h3>", "<h4>", "</h4>",
    '<u class="ref">R{n}</u>', "<u>{n}</u>", '<a href="/p/{n}">x</a>', '<a href="x/../{n}?q#f">x</a>', "<a>no</a>",
    '<a href="//h/{n}" href="no">', "</a>", '<p class="no">n</p>', "<p>d {n}\n\t é\xa0x</p>", "<p>a<!-- c -->b <br> c",
    '<div class="pic"><img src="/i{n}"></div>', '<div class="pic"><p><img src="no"></p></div>', "<img src=z{n} />",
    '<b class="price">{n} EUR\n/ </b>', '<b class="price"> / </b>', "<b x='1&amp;2'>B{n}</b>", "<i>1</i><i>I{n}</i>",
    '<i class="own"> </i>', '<i class="own">O{n} \\t &lt;!-- x --&gt; y</i>', '<s data-s="av{n}"> A  {n} </s>',
    '<template>&lt;p&gt;&lt;i class="own"&gt;T{n} &amp;amp;&lt;b&gt;z&lt;/b&gt;&lt;/i&gt;</template>',
    "<template><i class=own>no</i></template>", "<template>&lt;i class='own' x&gt;&lt;/i></template>",
    "<template>plain</template>", "<template><p>&lt;b><i class=own>{n}</p></template>", "<template>&lt;![x</template>",
    "<table><tr><th>K{n}</th><td>V{n}</td></tr><tr><th>K{n}</th><td>W</td></tr><tr><th> </th><td>x</td></tr><tr></tr>",
    "</table>", "a > b", "a < b", "&copy; &unknown; &#233;", "<script>'<b class=price>no</b>'</script>", "<!-- <b> -->",
    '<div id="c">', "<div id=c{n}>", "<p><b>k</b><i>v{n}</i></p>", "<A HREF='&#47;q'>", '<p title="a > b">', " ", "\n", "</p>",
    '<u class="ref" title="it\'s">Q</u>', '<u title="{n}" class="ref y">Q{n}</u>', "&#" + "9" * 5000 + ";",
]


def made_pages(count: int) -> list[str]:
    deal = random.Random(7)
    pages = ["", "x", " ", "<", "<b", "<![x", '<div id="c"><i class="own"></i></div>']
    # Some short lists of pieces come again with other values, as pages of a site do.
    shapes = [deal.choices(PIECES, k=deal.randrange(3, 30)) for _ in range(count // 3)]
    while len(pages) < count:
        pages.append("".join(piece.replace("{n}", str(deal.randrange(99))) for piece in deal.choice(shapes)))
    whole = '<main><div class="list"><article class="card">'
    return pages + [whole + page for page in pages]


@pytest.mark.parametrize("spec", [SPEC, BARE, ONLY_SPECS])
@pytest.mark.parametrize("window", [0, parse.ESCAPE_WINDOW])
def test_cards_are_those_of_the_tree(spark, spec, window):
    rows = [*enumerate(made_pages(1200)), (-1, None)]
    pages = spark.createDataFrame(rows, "k INT, html STRING").repartition(3)
    tree = parse_pages(pages, escape_window=window).withColumn("headings", F.array())
    fast = variant_rows(parse_pages(pages, escape_window=window, cards=spec), ["k"], spec)
    slow = variant_rows(tree, ["k"], spec)
    assert fast.columns == slow.columns
    want, got = (sorted(map(str, frame.collect())) for frame in (slow, fast))
    assert len(want) > 100 and got == want


def test_shared_shapes_are_built_once(monkeypatch):
    """Selectors are tried once for pages of a shape, and no tree is built for a page of its own."""
    tries, trees = [], []
    own = found._plan
    monkeypatch.setattr(found, "_plan", lambda *a: (tries.append(1), own(*a))[1])
    monkeypatch.setattr(found, "read_tree", lambda page: (trees.append(page), parse.read_tree(page))[1])
    page = '<div id="c"><a href="/{0}">x &amp; y > z</a><template>&lt;i class="own"&gt;{0}&lt;/i&gt;</template></div>'
    reader = found.CardReader(found.read_rule(**BARE))
    for start in range(0, 300, 100):
        cards, bad = reader.read(pa.array([page.format(i) for i in range(start, start + 100)]))
        assert [[(c["url"], c["your_price"]) for c in page] for page in cards.to_pylist()] == [
            [(f"/{i}", str(i))] for i in range(start, start + 100)
        ]
        assert not bad
    assert len(tries) == 2 and not trees  # one of the page, one of its template


def test_what_is_kept_is_bounded(monkeypatch):
    monkeypatch.setattr(parse, "_KEPT_PARTS", 50)
    monkeypatch.setattr(parse, "_KEPT_TAGS", 20)
    monkeypatch.setattr(parse, "_KEPT_CHARS", 5)
    reader = found.CardReader(found.read_rule(**BARE))
    for i in range(300):
        page = f'<div id="c">{"<p>" * (i % 7)}<b x="{i}" id="{i}">n</b><b x="1&amp;2">{i}</b><a href="{i}" y{i % 9}="">'
        cards, _ = reader.read(pa.array([page, f'<div id="{i}">', page]))
        assert [[(c["ref"], c["url"]) for c in page] for page in cards.to_pylist()] == [
            [(str(i), str(i))], [], [(str(i), str(i))]
        ]
        assert len(reader.shapes.frames) < 30 and len(reader.plans) < 30


@pytest.mark.parametrize("odd", ["", "<script></script>", "<b>x</b>"])
def test_cards_in_cards_are_handed_over_in_parts(monkeypatch, odd):
    """Elements left open nest, so a text may be in all cards before it."""
    monkeypatch.setattr(found, "_MOST_CHARS", 20_000)
    spec = {"variant_selector": "div", "fields": {"title": "p"}}
    pages = [odd + f"<div><p>{i} text" * (5 * i) for i in range(20)]
    reader = found.CardReader(found.read_rule(**spec))
    parts = [*reader.parts(pa.array(["cut", *pages])[1:])]
    assert len(parts) > 2 and [at for at, _ in parts] == [sum(len(p) for _, p in parts[:i]) for i in range(len(parts))]
    got = [page for _, part in parts for page in part.to_pylist()]
    assert [[c["title"] for c in page] for page in got] == [
        [" ".join([f"{i} text"] * (5 * i - n)) for n in range(5 * i)] for i in range(20)
    ]


def test_frames_of_tags():
    """A tag read by what it shares with others is the tag read by itself."""
    tags = [
        'a href="{n}"', 'a href="1" href="{n}"', 'a p=v0 x="{n}" x="v1"', "a t='\"{n}\"'", "a t='x' u=\"{n}\"",
        'a class="x {n}" u="{n}"', 'a x="1" x="1" y=1', 'a x="1" x="{n}" y=1', '/a x="{n}"', '!-- "{n}" --', 'a"{n}"',
        'a x="{n}" y', 'a x="{n}" /', 'a X="{n}"', 'br x="{n}"', 'a x="{n}"y="z"', 'script x="{n}"', 'a x="&amp;{n}"',
    ]
    framed, plain = parse._Shapes(), parse._Shapes()
    for n in ["1", "2", "it's", "a=b", "  ", "", "&lt;", "x y"]:
        for tag in tags:
            text = tag.replace("{n}", n)
            got, want = framed.tag(text), plain._tag(text)
            assert (got is None) == (want is None), text
            if got is not None:
                assert framed.by_number[got[0]] == plain.by_number[want[0]]
                assert (got[1], [*got[2]]) == (want[1], [*want[2]])
    assert framed.frames


def test_cleaning_is_that_of_the_column(spark):
    deal = random.Random(3)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    signs = [*spaces, "\\t", "\\n", "\\r", "\\", "<!--", "-->", "<!-", "\\x3C!----&gt;", "\\x3C!---->", "a", "é", "​", "中", " ", ""]
    texts = ["", " ", *spaces, *["".join(deal.choices(signs, k=deal.randrange(1, 9))) for _ in range(3000)]]
    assert {*spaces} == {c for c in map(chr, range(0x110000)) if c.isspace()} and len(SPACE)
    frame = spark.createDataFrame([*enumerate(texts)], "k INT, t STRING")
    want = dict(frame.select("k", clean_column(F.col("t"))).collect())
    got = found._cleaned(pa.array(["cut", *texts])[1:]).to_pylist()
    assert got == [want[i] for i in range(len(texts))]


def test_plain_addresses(spark):
    urls = ["/p", "/", "//h/p", "/.", "/..", "/a/./b", "/a/../b?x=/..", "/a?/.", "/a.b", "/a/.b", "", "?q", "#f", "x", "a:b", None]
    frame = spark.createDataFrame([(u,) for u in urls], "u STRING")
    got = [r[0] for r in frame.select(absolute_url(F.col("u"), "https://h.test/d/e?f#g")).collect()]
    assert got == [
        "https://h.test/p", "https://h.test/", "https://h/p", "https://h.test/", "https://h.test/", "https://h.test/a/b",
        "https://h.test/b?x=/..", "https://h.test/a?/.", "https://h.test/a.b", "https://h.test/a/.b",
        "https://h.test/d/e?f#g", "https://h.test/d/e?q", "https://h.test/d/e?f#f", "https://h.test/d/x", "a:b", None,
    ]
