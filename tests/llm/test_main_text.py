from __future__ import annotations

import html
import re

import pytest

from speclake.llm import main_text as M

LONG = "This paragraph of the article is long enough to count as content, with many words in it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=/>x</a></nav>", ""),
        ("only text &amp; &eacute;", "only text & é"),
        (f"<article><h1>T</h1><p>{LONG}<br>b\n c<p>d<b>e</b>f</article><footer>g</footer>",
         f"T {LONG} b c def"),
        (f"<div class=menu>m</div><div class=post><h2>T</h2><p>{LONG}</p><p>s</p><p>{LONG}</p></div>"
         "<div class='sidebar'><p>More of our posts are listed here with long texts</p></div>"
         "<div id=comments><p>I liked it a lot and want to say so at some length!</p></div>"
         "<div class='cookie-notice'>We use cookies</div><form>Send<input></form>",
         f"T {LONG} s {LONG}"),
        (f"<main><p>{LONG}</p><aside>a</aside><script>p('</p>')</script><style>p{{}}</style></main>",
         LONG),
        (f"<p>{LONG}</p><div hidden>h</div><div style='display: none'>n</div>", LONG),
    ],
)
def test_pages(page, want):
    assert M.main_text(page) == want


def test_smoothing_keeps_the_sum():
    import numpy as np

    values = np.array([0, 0, 0, 0, 0, 10.0, 0, 0, 0, 0, 0])
    out = M.smoothed(values)
    assert len(out) == len(values) and out.argmax() == 5 and abs(out.sum() - 10) < 1e-9


def test_given_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = M.extract(pages).collect()
    texts = {r.page_id: r.html for r in pages.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", texts[r.page_id], re.S)[1]
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)>", " ", article))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


LINKED = (
    "<ol><li><a href=/1>First source, 2001</a></li><li><a href=/2>Second source</a>.</li></ol>"
    "<table><tr><th>Name</th><th>Mass</th></tr><tr><td><a href=/a>Bolt</a></td><td>5 g</td></tr></table>"
    "<dl><dt>See</dt><dd><a href=/b>Nuts</a></dd></dl>"
)
READ = "First source, 2001 Second source. Name Mass Bolt 5 g See Nuts"


@pytest.mark.parametrize("tag", ["article", "main"])
def test_links_in_articles_stay(tag):
    page = f"<ul><li><a href=/>Home</a></ul><{tag}><h1>T</h1><p>{LONG}</p>{LINKED}</{tag}>"
    assert M.main_text(page) == f"T {LONG} {READ}"
    apart = f"<{tag}><p>{LONG}</p><nav>{LINKED}</nav><div class=related>{LINKED}</div></{tag}>"
    assert M.main_text(apart) == LONG


def test_links_in_articles_of_a_wider_region():
    parts = "".join(f"<article><p>{LONG}</p>{LINKED}<p>{LONG}</p></article>" for _ in range(3))
    assert M.main_text(f"<div>{parts}</div>") == " ".join([f"{LONG} {READ} {LONG}"] * 3)


def test_links_elsewhere_are_left_out():
    page = f"<div><p>{LONG}</p><ul><li><a href=/>Home</a></li></ul><p>{LONG}</p></div>"
    assert M.main_text(page) == f"{LONG} {LONG}"


INSIDE = f"<article><h1>T</h1><p>{LONG}</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content has-sidebar'>{INSIDE}</div>",
        f"<div class='form-horizontal layout-sidebar-right'><ul><li><a href=/>x</a></ul>{INSIDE}</div>",
        f"<div class=sidebar><div id=search><p>Search</p>{INSIDE}<p>More</p></div></div>",
        f"{INSIDE}<section class=comment-list><article><p>{LONG}</p></article></section>",
        f"{INSIDE}<div class=sidebar><article><p>{LONG}</p></article></div>",
        f"<article><h1>T</h1><p>{LONG} <button>Share this</button><span class='advert'>Buy now</span></p>"
        "<svg><text>drawn</text></svg><textarea>typed</textarea></article>",
    ],
)
def test_wrappers_and_inline_parts(page):
    assert M.main_text(page) == f"T {LONG}"


@pytest.mark.parametrize(
    "part",
    ["<div class='notice-period'>{}</div>", "<section class='related-work'>{}</section>",
     "<section id='search-algorithm'>{}</section>", "<p class='no-comment'>{}</p>"],
)
def test_sections_of_an_article_stay(part):
    page = f"<article><h1>T</h1>{part.format('<p>' + LONG + '</p>')}<p>{LONG}</p></article>"
    assert M.main_text(page) == f"T {LONG} {LONG}"


def test_deep_and_long_pages_take_no_square_time():
    import time

    start = time.perf_counter()
    deep = "<div>" * 50_000 + LONG + "</div></b>" * 50_000
    assert M.main_text(deep) == LONG
    assert M.main_text(f"<p>{LONG}</p>" * 30_000) == " ".join([LONG] * 30_000)
    assert time.perf_counter() - start < 30


def test_tables_of_any_shape(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", "t", 5), (1, "u", f"<p>{LONG}</p>", "t", 5), (None, None, None, "t", 6)]
    frame = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, text STRING, n_chars INT")
    found = M.extract(frame)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text) for r in found.collect()) == [(0, ""), (1, LONG), (1, LONG)]
    assert M.extract(frame.limit(0)).collect() == []
