"""Text, address and JSON functions against plain Python on small inputs."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from speclake.functions import json_paths, text, urls
from speclake.operators.selectors import Step, selector


def apply(spark, function, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[1] for r in frame.select("i", function(F.col("v"))).orderBy("i").collect()]


def test_clean_text(spark):
    values = [None, "", " a\u00a0\u2003b\x1c\x85c ", "a\\tb\\nc\\rd", "C:\\temp", "x\\x3C!---->y",
              "x\\x3C!----&gt;y", "a<!-- b\n --> c<!-- open", "\u200bz", "a\t\r\n\x0b\x0cb"]
    assert apply(spark, text.clean_text, values) == [
        "", "", "a b c", "a b c\\rd", "C: emp", "x y", "x y", "a c<!-- open", "\u200bz", "a b"
    ]


def test_clean_text_of_long_runs(spark):
    long = "\\t \n" * 50_000
    assert apply(spark, text.clean_text, ["a" + long + "b"]) == ["a b"]


def test_clean_plain_text(spark):
    values = ["a\\rb\\nc", " a\u00a0b ", "a \u00a0 b", "x<!-- y -->", "a\n\n\tb"]
    assert apply(spark, text.clean_plain_text, values) == [
        "a b c", "a\u00a0b", "a b", "x<!-- y -->", "a b"
    ]


def test_small_text_functions(spark):
    assert apply(spark, text.strip_tags, [" a<br />b<br>c<i x>d</i> "]) == ["a\nb\ncd"]
    assert apply(spark, text.css_url, ["a:url('x.png') url(y)", "url(\"z\")", "none"]) == [
        "x.png", "z", None
    ]
    assert apply(spark, text.clean_list_price, ["9.058,00 EUR /", "5 //", "/", "7"]) == [
        "9.058,00 EUR", "5 /", "", "7"
    ]
    assert apply(spark, text.clean_your_price, [" \n", " 3 /"]) == [None, "3 /"]
    assert apply(spark, text.preview, ["x" * 51, "x" * 50]) == ["x" * 50 + "...", "x" * 50]


def test_file_names(spark):
    values = [
        "https://www.a.com/x/y.html?p=1#t", "http://u@b.www.c.de:80/", "https://x.y/\u00e9 a/",
        "not an address", "http://h/a;b/c;d", "https://h/" + "p" * 300, "http://h|x/y",
    ]
    assert apply(spark, urls.page_file_name, values) == [
        "a.com_x_y.html.html", "u_b.c.de_80.html", "x.y_\u00e9_a.html", "_not_an_address.html",
        "h_a_b_c.html", "h_" + "p" * 198 + ".html", "h_x_y.html",
    ]
    day = F.lit("2026-01-02").cast("date")
    assert apply(spark, lambda v: urls.result_file_name(v, day), [*values[:1], None, ""]) == [
        "260102_a_com_x_y_html_p_1_t.json", "260102_unknown_url.json", "260102_unknown_url.json"
    ]


def test_absolute_url(spark):
    from urllib.parse import urljoin

    base = "https://www.h.be"
    values = ["/a", "a/b", "//c/d", "?q", "#f", "http:x", "https://y/z", "mailto:m", "./a", "../a",
              "../../a/b", ""]
    want = [v if v.startswith(("http:", "https:")) else urljoin(base, v) for v in values]
    assert apply(spark, lambda v: urls.absolute_url(v, base), values) == want
    assert apply(spark, lambda v: urls.absolute_url(v, ""), ["/a"]) == ["/a"]


def test_articles(spark):
    values = ["https://p/x-2905743", "x-1/", "x-1//", "x-1?a", "12", "a/12", "x-1a", "-"]
    assert apply(spark, urls.trailing_article, values) == [
        "2905743", "1", "1", None, "12", None, None, None
    ]
    made = apply(spark, urls.article_pdf_url, ["2905743", "7" * 200])
    assert "/MjkwNTc0Mw==?_realm=be&_locale=nl-BE&blocks=commercial-data%2C" in made[0]
    assert "\n" not in made[1] and "\r" not in made[1]


def test_site_and_rendition(spark):
    assert apply(spark, urls.site_class, [
        "https://MALL.siemens.com/se.com", "https://x.phoenixcontact.com", "https://house.com/",
        "https://x.test/siemens", "bad",
    ]) == ["siemens", "phoenix", "schneider", "other", "other"]
    assert apply(spark, urls.set_rendition, [
        "h?p_Doc_Ref=1&p_File_Type=rendition_1500_jpg&default_image=DefaultProductImage.png&x=1",
        "h?rendition_20_gif&default_image=DefaultProductImage.png", "h",
    ]) == [
        "h?p_Doc_Ref=1&p_File_Type=rendition_369_jpg",
        "h?rendition_369_jpg&default_image=DefaultProductImage.png", "h",
    ]


def test_attribute_repair(spark):
    values = [r'{"a":"it\'s \d \\\"x"}', '{&quot;a&quot;:&quot;1 &lt; 2 &amp; 3&quot;}',
              r'{"a":"C:\path\new"}', r'{"a":"\\\'q"}', "{bad", '{"a":1} x']

    def python(raw):
        for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            raw = raw.replace(old, new)
        raw = re.sub(r"(\\+)'", lambda m: m.group(1) + "\\u0027", raw)
        raw = re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", raw)
        return re.sub(r'\\+"', r"\\" + '"', raw)

    assert apply(spark, json_paths.repair_attribute_text, values) == [python(v) for v in values]

    def parsed(raw):
        try:
            return json.loads(python(raw))
        except json.JSONDecodeError:
            return None

    got = apply(spark, lambda v: F.to_json(json_paths.repair_attribute(v)), values)
    assert [json.loads(g) if g else None for g in got] == [parsed(v) for v in values]


def test_truth_of_json(spark):
    values = ['"0"', '""', "0", "0.0", "1", "false", "true", "null", "[]", "{}", "[0]", '{"a":0}']
    got = apply(spark, lambda v: json_paths.is_truthy(json_paths.parse_strict(v)), values)
    assert got == [bool(json.loads(v)) for v in values]


def test_strict_json(spark):
    values = ['{"a":1}', '{"a":1}{', '{"a":1},{"b":1}', "1 2", "", " 1 ", "nul", '{"a":1,"a":2}']
    got = apply(spark, lambda v: F.to_json(json_paths.parse_strict(v)), values)
    assert got == ['{"a":1}', None, None, None, None, "1", None, '{"a":2}']


def test_paths(spark):
    frame = spark.createDataFrame([('{"a":{"b c":[{"d":1},{"d":null}]},"0":5}',)], "v STRING")
    v = F.parse_json("v")

    def get(path, **how):
        return json_paths.as_text(json_paths.path_get(v, path, **how))

    row = frame.select(
        get("a.b c[0].d", indexes=True), get("a.b c.0.d", indexes=True), get("a.b c.0.d"),
        get("0"), get(""), json_paths.path_get(v, "a.b c[1].d", indexes=True).isNull(),
    ).first()
    assert tuple(row) == ("1", "1", None, "5", None, False)


def test_selector_reading():
    assert selector("A.x.y[b][c*='d e']:not(.z):nth-of-type(2)") == ((
        Step("a", None, ("x", "y"), (("b", "", ""), ("c", "*=", "d e")), ("z",), 2),
    ),)
    assert selector("#i p , *") == ((Step(id="i"), Step("p")), (Step(),))
    assert selector("a > b c[d ^= 'e']") == (
        (Step("a"), Step("b", child=True), Step("c", attrs=(("d", "^=", "e"),))),
    )
    for bad in ("> b", "a:hover", "a ~ b", "[a|='b']"):
        with pytest.raises(ValueError):
            selector(bad)
