"""A listing in fragments gives what its merged page gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from speclake.plans import fragments
from speclake.sources.sites import Sites

PIECES = (
    "<h2>Title {n}</h2>", "<h3>Part {n}</h3>", "<h4>skip</h4>", "<h2> </h2>",
    '<a class="k">x</a>', '<a class="k" href="/k{n}">x</a>', '<a class="k" href="">x</a>',
    '<a class="d" href="/d{n}">x</a>', '<a class="d" href="/d{n}.pdf">x</a>', '<a class="e" href="/e{n}.pdf">x</a>',
    '<a href="/f{n}.pdf">Datasheet</a>', '<img class="y" src="/y{n}">', '<img class="y">', '<img class="z" src="/z{n}">',
    "<p class=t></p>", "<p class=t>text {n}</p>", '<meta name="description">',
    '<meta name="description" content=" about {n} ">', '<div class="cards"></div>',
    '<div class="cards"><div class="card"><h3>Doc {n}</h3><ul><li class="language selected" data-url="/u{n}"></li></ul></div></div>',
    "<ul><li><b>key</b><i>{n}</i></li></ul>", "<dl><dt>term</dt><dd>{n}</dd></dl>",
    "<h2>Productdetails</h2><dl><dt>Artikelnummer</dt><dd>{n}</dd></dl>",
    '<link rel="canonical" href="https://h.test/x-{n}">', "<table><tr><td>cell<td>{n}</table>",
    '<script type="application/ld+json">{{"image": "/ld{n}.png"}}</script>',
)
SPECS = [
    {"type": "attribute", "selector": "a.k", "target_key": "K"},
    {"type": "text", "selector": "p.t"},
    {"type": "meta_description"},
    {"type": "datasheet_link", "selectors": [".d", ".e"], "base_url": "https://h.test"},
    {"type": "image", "selectors": [".z", ".y"], "target_key": "I1"},
    {"type": "image", "selectors": [".z", ".y"], "take": "last", "target_key": "I2", "fallback_jsonld": True},
    {"type": "image", "selectors": [".z", ".y"], "take": "all", "target_key": "I3"},
    {"type": "vega_pdf"},
    {"type": "li_split", "skip_texts": ["skip"], "items": "li:not(.language)"},
    {"type": "dl"},
    {"type": "table"},
    {"type": "phoenix_pdf"},
    {"type": "attribute", "selector": "a.d", "target_key": "K"},
]


@pytest.mark.parametrize("seed", [1, 2])
def test_fragments_equal_the_merged_page(spark, extract, seed):
    rng = random.Random(seed)
    merged, rows = {}, []
    for page in range(60):
        pieces = [
            "".join(rng.choice(PIECES).format(n=100 * page + 10 * f + i) for i in range(rng.choice([0, 1, 3])))
            for f in range(rng.choice([1, 3, 6]))
        ]
        merged[f"p{page}"] = "".join(pieces)
        rows += [(f"p{page}", f * 70_000, piece) for f, piece in enumerate(pieces)]
    want = {
        (page, section, key, value)
        for page, hits in extract(SPECS, merged).items()
        for (section, key), value in {(s, k): v for s, k, v in hits}.items()
    }
    frame = spark.createDataFrame(rows, "page STRING, frag_no LONG, html STRING")
    sites = Sites({"generic": {"name": "Any", "specs": SPECS}})
    found = fragments.fragment_kv(
        fragments.extract_fragments(frame, F.lit("generic"), ["page"], sites), ["page"]
    )
    assert {(r.page, r.section, r.key, r.value) for r in found.collect()} == want


def test_no_fragments(spark):
    frame = spark.createDataFrame([], "page STRING, frag_no LONG, html STRING")
    sites = Sites({"generic": {"name": "Any", "specs": SPECS}})
    pieces = fragments.extract_fragments(frame, F.lit("generic"), ["page"], sites)
    assert fragments.fragment_kv(pieces, ["page"]).collect() == []


CUT_PIECES = (
    '<div class="box">', "<div>", "</div>", "</div>", "<section>", "</section>", "<p>", "</p>", "<br>",
    "</table><h2>Title {n}</h2>", "</table><h3>Part {n}</h3>", "<script>'</div>'</script>",
    "<dl><dt>a</dt><dd>{n}</dd></dl>", "<table><tr><td>b{n}</td><td>{n}</td></tr></table>",
    "<tr><td>c</td><td>{n}</td></tr>", "</table><table>", "</table>",
    "<li><b>d</b><i>{n}</i></li>", "<dl><dt>e{n}</dt><dd>{n}</dd></dl>",
)
CUT_SPECS = [
    {"type": "dl", "container": "div.box"},
    {"type": "li_split", "container": "section", "items": "li", "section_headers": ["h3"]},
    {"type": "table", "container": "div.box"},
    {"type": "dl", "container": "section div.box"},
    {"type": "li_split", "container": "div.box p", "items": "li"},
    {"type": "dl"},
]


@pytest.mark.parametrize("seed", [1, 2])
def test_containers_reach_over_pieces(spark, extract, seed):
    rng = random.Random(seed)
    merged, rows = {}, []
    for page in range(80):
        parts = [
            "".join(rng.choice(CUT_PIECES).format(n=100 * page + 10 * f + i) for i in range(rng.choice([0, 1, 3])))
            for f in range(rng.choice([1, 4, 9]))
        ]
        merged[f"p{page}"] = "".join(parts)
        rows += [(f"p{page}", f * rng.choice([1, 3000]), part) for f, part in enumerate(parts)]
    rows = [(p, n, h) for n, (p, _, h) in zip(order_of(rows), rows, strict=True)]
    want = {
        (page, section, key, value)
        for page, hits in extract(CUT_SPECS, merged).items()
        for (section, key), value in {(s, k): v for s, k, v in hits}.items()
    }
    frame = spark.createDataFrame(rows, "page STRING, frag_no LONG, html STRING")
    sites = Sites({"generic": {"name": "Any", "specs": CUT_SPECS}})
    found = fragments.fragment_kv(
        fragments.extract_fragments(frame, F.lit("generic"), ["page"], sites, pieces=True), ["page"]
    )
    assert {(r.page, r.section, r.key, r.value) for r in found.collect()} == want


def order_of(rows):
    """Rising numbers within a page, some far apart, so that pages lie in several ranges."""
    at, last, out = 0, None, []
    for page, step, _ in rows:
        at = at + 1 + step if page == last else 0
        last = page
        out.append(at)
    return out


def test_words_join():
    """Folding words in any cuts gives the open elements of the whole."""
    from speclake.operators.open_elements import Word, word_of

    rng = random.Random(0)
    tags = ["<a>", "<b>", "<c>", "</a>", "</b>", "</c>", "<br>", "text"]
    for _ in range(300):
        pieces = ["".join(rng.choice(tags) for _ in range(rng.randint(0, 5))) for _ in range(6)]
        stack = []
        for n, piece in enumerate(pieces):
            place = 0
            for tag in piece.replace("text", "").replace("<", " <").split():
                if tag[1] != "/":
                    if tag != "<br>":
                        stack.append((tag[1:-1], f"{n}:{place}"))
                    place += 1
                elif any(name == tag[2:-1] for name, _ in stack):
                    while stack.pop()[0] != tag[2:-1]:
                        pass
        words = [word_of(piece, n) for n, piece in enumerate(pieces)]
        want = [f'<{name} speclake-opened="{place}">' for name, place in stack]
        cut = rng.randint(0, 6)
        left, right = Word(), Word()
        for w in words[:cut]:
            left.extend(w)
        for w in words[cut:]:
            right.extend(w)
        whole = Word(left.tokens, whole=True)
        whole.extend(right.tokens)
        assert whole.tokens == want


@pytest.mark.parametrize("pieces", [False, True])
def test_nothing_of_a_listing_is_broadcast(spark, pieces):
    """Rows that grow with the listings would fill the driver."""
    rows = [(i % 3, i, PIECES[i % len(PIECES)].format(n=i)) for i in range(60)]
    frame = spark.createDataFrame(rows, "page LONG, frag_no LONG, html STRING")
    sites = Sites({"generic": {"name": "Any", "specs": SPECS}})
    found = fragments.extract_fragments(frame, F.lit("generic"), ["page"], sites, pieces=pieces)
    written = fragments.fragment_kv(found, ["page"])
    assert written.collect()
    plan = written._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_words_of_regular_pieces():
    """Pieces of regular markup are read by their tags alone, with the words of an HTML reader."""
    from speclake.operators.open_elements import _regular_word, _Tags, word_of

    tags = _Tags()
    for n, piece in enumerate((
        '<DIV Class="a"\n>x<p/><br></p><b>y</b><!-- c --></i><i a=1>', "</main><main><p>", "<!DOCTYPE html><hr><u>", "",
    )):
        assert _regular_word(piece, n, tags) == word_of(piece, n)
    for piece in ("<title><b></title>", "a <b", '<a t="<u>">', "</p x>", "<p cla"):
        assert _regular_word(piece, 1, tags) is None
        assert word_of(piece, 1, tags) == word_of(piece, 1)


def test_words_are_folded_without_a_call_per_group(spark):
    """Many listings of few pieces: groups are told in the stream of sorted rows."""
    from speclake.operators.open_elements import MARK, opened_before

    nan = float("nan")
    rows = [(k, n, h) for k in (None, nan, 1.0) for n, h in ((5000, "</p>"), (2, "<p>"), (1, "<div>"), (7, "</div><i>"))]
    pieces = spark.createDataFrame(rows, "k DOUBLE, n LONG, html STRING")
    opened = opened_before(pieces, ["k"], "n", "html", lambda rows: rows)
    assert "InArrow" in (plan := opened._jdf.queryExecution().executedPlan().toString())
    assert "FlatMapGroupsInArrow" not in plan
    got = sorted((str(r.k), r.n, r.opened) for r in opened.collect())
    div, p, i = (f'<{t} {MARK}="{n}:0">' for t, n in (("div", 1), ("p", 2), ("i", 7)))
    want = ((2, [div]), (5000, [i]), (7, [div, p]))
    assert got == sorted((k, n, o) for k in ("None", "nan", "1.0") for n, o in want)
