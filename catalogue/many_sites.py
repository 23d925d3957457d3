"""A thousand generated sites in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import markup, query
from catalogue.rendered import KEY, mixed_pages, parts
from speclake.plans import assemble, site_tables
from speclake.sources.sites import Sites

P = F.col
MANY = 1000


def generated_sites(many: int = MANY) -> tuple[Sites, tuple[tuple[str, str], ...]]:
    """Sites told by address, id, class, text or selector, with specs of six types."""

    def entry(i: int) -> dict:
        rules = (
            {"id": f"id-{i}"},
            {"class_contains": f"cls{i}x"},
            {"text_contains": f"SOLD by Shop {i}."},
            {"selector": f"div.box{i} > b[data-s='{i}']"},
        )
        target = {"target_section": f"S{i}"}
        specs = (
            {"type": "table", "container": f"#c{i}", "tables": "table.t", "value_column": 1 + i // 6 % 2},
            {"type": "dl", "container": f"section.d{i}"},
            {"type": "rows", "rows": f"div.r{i}", "key": "b", "value": "i"},
            {"type": "attribute", "selector": f"a.k{i}", "target_key": "K", **target},
            {"type": "text", "selector": f"p.n{i}", "target_key": "Note", **target},
            {"type": "label_value", "elements": ["p"]},
        )
        return {"name": f"Shop {i}", "priority": 10 + i % 3, "detect": [rules[i % 4]], "specs": [specs[i % 6]]}

    by_address = tuple((f"shop{i}.test", f"shop{i}") for i in range(0, many, 5))
    return Sites({f"shop{i}": entry(i) for i in range(many)}), by_address


def shop_pages(spark, folder, many: int = MANY):
    """Every part on a page of one of the sites, beside elements that other sites read."""
    s, other = P(KEY) % many, (P(KEY) + 1) % many
    mark = (
        F.when(s % 4 == 0, markup('<u id="id-', s, '"></u>'))
        .when(s % 4 == 1, markup('<u class="a xcls', s, 'xx"></u>'))
        .when(s % 4 == 2, markup("<em>Sold BY Shop ", s, ".</em>"))
        .otherwise(
            markup('<div class="box', other, '"><b data-s="', other, '"></b></div>',
                   '<div class="box', s, '"><b data-s="', s, '"></b></div>')
        )
    )
    head = F.when(
        s % 5 == 0, markup('<link rel="canonical" href="https://SHOP', s, '.test/', P(KEY), '">')
    ).otherwise(F.lit(""))
    # Sites told by their address hold no other mark.
    body_mark = F.when(s % 5 == 0, F.lit("")).otherwise(mark)

    def boxes(number, *values):
        size, kind, brand, maker = values
        return markup(
            '<div id="c', number, '"><table class="t"><tr><td>Size</td><td>', size, "</td><td>", kind,
            '</td></tr></table></div><section class="d', number, '"><dl><dt>Brand</dt><dd>', brand,
            '</dd></dl></section><div class="r', number, '"><b>Maker</b><i>', maker, "</i></div>",
        )

    no = F.lit("no")
    page = markup(
        "<html><head>", head, "</head><body>", body_mark, "<h2>", P("p_name"), "</h2>",
        boxes(other, no, no, no, no), boxes(s, P("p_size"), P("p_type"), P("p_brand"), markup("M", P("p_brand"))),
        '<a class="k', s, '" href="/k/', P(KEY), '">x</a><p class="n', s, '">Box: ', P("p_type"),
        "</p></body></html>",
    )
    return parts(spark, folder).select(KEY, page.alias("html"))


@query("thousand_sites", f"""
    WITH t AS (SELECT *, {KEY} % {MANY} AS s FROM part)
    SELECT {KEY}, 'Shop ' || s AS vendor,
           CASE s % 6 WHEN 3 THEN 'S' || s WHEN 4 THEN 'S' || s ELSE p_name END AS section,
           CASE s % 6 WHEN 0 THEN 'Size' WHEN 1 THEN 'Brand' WHEN 2 THEN 'Maker' WHEN 3 THEN 'K'
                      WHEN 4 THEN 'Note' ELSE 'Box' END AS key,
           CASE s % 6 WHEN 0 THEN CASE s // 6 % 2 WHEN 0 THEN CAST(p_size AS VARCHAR) ELSE p_type END
                      WHEN 1 THEN p_brand WHEN 2 THEN 'M' || p_brand WHEN 3 THEN '/k/' || {KEY}
                      WHEN 4 THEN 'Box: ' || p_type ELSE p_type END AS value
    FROM t""")
def thousand_sites(spark, folder):
    sites, by_address = generated_sites()
    extracted = site_tables.extract_pages(shop_pages(spark, folder), sites, by_address=by_address)
    return assemble.kv_from_hits(extracted, [KEY, "vendor_name"]).select(
        KEY, P("vendor_name").alias("vendor"), "section", "key", "value"
    )


@query("mixed_facts_by_table", f"""
    WITH t AS (
      SELECT *, CASE {KEY} % 9
        WHEN 0 THEN 'ABB' WHEN 3 THEN 'VEGA' WHEN 4 THEN 'Schneider Electric'
        WHEN 5 THEN 'Phoenix Contact' WHEN 7 THEN 'Schneider Electric' WHEN 8 THEN 'Generic'
        ELSE 'Siemens' END AS vendor
      FROM part)
    SELECT {KEY}, vendor,
           CASE vendor WHEN 'Generic' THEN p_name WHEN 'Schneider Electric' THEN 'Metadata'
                       ELSE 'Product Info' END AS section,
           CASE vendor WHEN 'Generic' THEN 'Size' WHEN 'Schneider Electric' THEN 'dataSheetTitle'
                       WHEN 'ABB' THEN 'Product Name' ELSE 'Description' END AS key,
           CASE vendor WHEN 'Generic' THEN CAST(p_size AS VARCHAR) ELSE p_name END AS value
    FROM t""")
def mixed_facts_by_table(spark, folder):
    """The built-in sites: some read as data, some by branches of their own."""
    extracted = site_tables.extract_pages(mixed_pages(spark, folder))
    return assemble.kv_from_hits(extracted, [KEY, "vendor_name"]).select(
        KEY, P("vendor_name").alias("vendor"), "section", "key", "value"
    )
