"""Listings of many pages, product cards, merged documents, and a page stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue.base import markup, query, rendering, sql_clean, table
from catalogue.rendered import KEY, kv, only, parts
from speclake.operators import listing
from speclake.operators.page import page_of
from speclake.operators.parse import parse_pages
from speclake.plans import fragments as frags
from speclake.plans.extraction import extract_documents
from speclake.plans.variants import variant_rows
from speclake.session import shared_root, staged
from speclake.sources.sinks import landed_pages, latest
from speclake.sources.sites import Sites, load_sites
from speclake.streaming import changes, landing
from speclake.streaming.pages import page_stream, stream_documents

P = F.col


# --- product cards -------------------------------------------------------------------------
@query("order_variants", """
    SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS item_reference,
           'Part ' || l_partkey AS title,
           'https://www.phoenixcontact.com/p/' || l_partkey AS url,
           CASE WHEN l_linenumber % 2 = 0 THEN '/i/' || l_suppkey || '.png' END AS image,
           CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR) || ' EUR' AS list_price,
           CASE l_linenumber % 3 WHEN 0 THEN CAST(l_suppkey AS VARCHAR)
                WHEN 1 THEN 'T' || l_suppkey END AS your_price,
           l_returnflag || ' ' || l_linestatus AS availability
    FROM lineitem
    UNION ALL
    SELECT l_orderkey, NULL, NULL, NULL, NULL, '', NULL, NULL FROM lineitem
    WHERE l_linenumber % 7 = 0""")
def order_variants(spark, folder):
    # Every line item is one landed fragment of its order's listing, so a
    # listing of any length is extracted in parallel.
    price = F.round(P("l_extendedprice") * 100).cast("bigint")
    image = F.when(P("l_linenumber") % 2 == 0, markup('src="/i/', P("l_suppkey"), '.png"')).otherwise(
        F.lit("")
    )
    own_price = (
        F.when(
            P("l_linenumber") % 3 == 0,
            markup('<i class="sh-DisplayUnitPrice__amount">', P("l_suppkey"), "</i>"),
        )
        .when(
            P("l_linenumber") % 3 == 1,
            markup('<template>&lt;p&gt;&lt;i class="sh-DisplayUnitPrice__amount"&gt;T',
                   P("l_suppkey"), "&lt;/i&gt;</template>"),
        )
        .otherwise(F.lit('<i class="sh-DisplayUnitPrice__amount"> </i>'))
    )
    # Text inside a template element is not page text.
    bare = F.when(
        P("l_linenumber") % 7 == 0,
        F.lit('<article class="se-result-pos"><template><b class="sh-ListPrice">5</b></template>'
              '</article>'),
    ).otherwise(F.lit('<article class="se-result-pos">no fields</article>'))
    page = markup(
        '<body><article class="se-result-pos x"><span class="se-result-pos-subtitle">',
        P("l_partkey"), '</span><a class="se-result-pos-item-title" href="/p/', P("l_partkey"),
        '"><span>Part ', P("l_partkey"), '</span></a><p class="se-pic"><img ', image,
        '></p><b class="sh-ListPrice">', price, " EUR\n/ </b>", own_price,
        '<u class="sh-AvailabilityTitle__text">', P("l_returnflag"), "  ", P("l_linestatus"),
        "</u></article>", bare, "</body>",
    )
    lines = rendering(table(spark, folder, "lineitem"))
    pages = lines.select("l_orderkey", page.alias("html"))
    spec = load_sites().spec_source("phoenix").specs[5]
    # These pages hold markup as text, so that says nothing about the whole page.
    parsed = parse_pages(pages, escape_window=0, cards=spec)
    return variant_rows(parsed, ["l_orderkey"], spec).select(
        "l_orderkey", "item_reference", "title", "url", "image", "list_price", "your_price",
        "availability",
    )


def _card_page():
    return markup(
        '<div class="card"><h3><a href="x/', P(KEY), '">', P("p_name"), '</a></h3><i class="ref">R',
        P(KEY), '</i><ul><li class="s"><b>Size</b><u>no</u></li><li class="s"><b>Size</b><u>',
        P("p_size"), '</u></li><li class="s"><b>Type</b><u>', P("p_type"),
        '</u></li><li class="s"><b> </b><u>x</u></li></ul></div><div class="card"></div>',
    )


_CARD_FIELDS = {
    "title": "h3", "ref": ".ref", "url": "h3 a", "list_price": ".ref",
    "specs": {"rows": "li.s", "key": "b", "value": "u"},
}


@query("nested_specs", f"""
    SELECT {KEY}, 0 AS item_no, p_name AS title, 'R' || {KEY} AS ref,
           'https://h.test/x/' || {KEY} AS url,
           'Size=' || p_size || ',Type=' || p_type AS specs
    FROM part""")
def nested_specs(spark, folder):
    pages = parts(spark, folder).select(KEY, _card_page().alias("html"))
    spec = {"variant_selector": "div.card", "base_url": "https://h.test", "fields": _CARD_FIELDS}
    rows = variant_rows(parse_pages(pages).withColumn("headings", F.array()), [KEY], spec)
    specs = F.array_join(
        F.transform(F.map_entries("specs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])),
        ",",
    )
    return rows.select(KEY, P("item_no").cast("int").alias("item_no"), "title", "ref", "url",
                       specs.alias("specs"))


@query("list_variants", f"""
    SELECT {KEY}, 'Product Variants' AS section, 'Items' AS key,
           '[{{"title":"' || p_name || '","ref":"R' || {KEY} || '","url":"x/' || {KEY}
           || '","specs":{{"Size":"' || p_size || '","Type":"' || p_type || '"}}}}]' AS value
    FROM part""")
def list_variants(spark, folder):
    pages = parts(spark, folder).select(KEY, _card_page().alias("html"))
    return kv(pages, only({
        "type": "list_variants", "variant_selector": "div.card", "fields": _CARD_FIELDS,
    }))


# --- pages of one listing ------------------------------------------------------------------------
@query("fragment_sections", """
    WITH t AS (
      SELECT user_id, event_id, event_type, props,
             last_value(CASE WHEN event_type = 'click' THEN 'Click ' || event_id END IGNORE NULLS)
               OVER (PARTITION BY user_id ORDER BY event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM events)
    SELECT user_id, event_id AS frag_no, coalesce(before, 'Unknown') AS section,
           'early' AS key, props AS value FROM t
    UNION ALL
    SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'Click ' || event_id
                                   ELSE coalesce(before, 'Unknown') END,
           'late', event_type FROM t""")
def fragment_sections(spark, folder):
    facts = frags.fragment_facts(_event_fragments(spark, folder), ["user_id"])
    return facts.select("user_id", "frag_no", "section", "key", "value")


def _event_fragments(spark, folder):
    heading = F.when(
        P("event_type") == "click", markup("<h3> </h3><h2>Click ", P("event_id"), "</h2>")
    ).otherwise(F.lit(""))
    page = markup(
        "<dl><dt>early</dt><dd>", P("props"), "</dd></dl>", heading, "<dl><dt>late</dt><dd>",
        P("event_type"), "</dd></dl>",
    )
    pages = rendering(table(spark, folder, "events")).select(
        "user_id", P("event_id").alias("frag_no"), page.alias("html")
    )
    return frags.extract_fragments(
        pages, F.lit("generic"), ["user_id"], only({"type": "dl", "container": "body"})
    )


@query("fragment_last_write", """
    WITH t AS (
      SELECT user_id, event_id, event_type, props,
             last_value(CASE WHEN event_type = 'click' THEN 'Click ' || event_id END IGNORE NULLS)
               OVER (PARTITION BY user_id ORDER BY event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM events),
    u AS (
      SELECT user_id, event_id, coalesce(before, 'Unknown') AS section, 'early' AS key,
             props AS value FROM t
      UNION ALL
      SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'Click ' || event_id
                                     ELSE coalesce(before, 'Unknown') END, 'late', event_type FROM t)
    SELECT user_id, section, key, arg_max(value, event_id) AS value
    FROM u GROUP BY user_id, section, key""")
def fragment_last_write(spark, folder):
    found = frags.fragment_kv(_event_fragments(spark, folder), ["user_id"])
    return found.select("user_id", "section", "key", "value")


_LANDED = "'<html><head><title>C' || conv_id || '</title></head><body><div id=\"se-result\">'"


@query("merge_fragments", f"""
    SELECT conv_id, 0 AS part, CAST(NULL AS BIGINT) AS frag_no, {_LANDED} AS html
    FROM conversations GROUP BY conv_id
    UNION ALL
    SELECT conv_id, 1, turn,
           CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN ''
                ELSE chr(10) || '<!-- PAGE BREAK -->' || chr(10) END
           || '<p>' || role || '</p><b>é' || turn || '</b>'
    FROM conversations
    UNION ALL
    SELECT conv_id, 2, NULL, '</div><footer>f</footer></body></html>'
    FROM conversations GROUP BY conv_id""")
def merge_fragments(spark, folder):
    page = markup(
        "<html><head><title>C", P("conv_id"), '</title></head><body><div id="se-result"><p>',
        P("role"), '</p><div class="x se-pagination"><a>1</a><i class=se-pagination></i></div><b>é',
        P("turn"), '</b><nav class="se-pagination">2</nav></div><footer>f</footer></body></html>',
    )
    turns = rendering(table(spark, folder, "conversations"))
    firsts = turns.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    body = page_of()
    landed = parse_pages(
        turns.select("conv_id", "turn", page.alias("html")), positions=True
    ).withColumn("headings", F.array())
    fragments = staged(landed.select(
        "conv_id", P("turn").alias("frag_no"),
        listing.inner_html(body, listing.RESULTS, listing.PAGINATION).alias("html"),
    ))
    skeletons = parse_pages(
        turns.join(firsts, ["conv_id", "turn"], "left_semi").select("conv_id", page.alias("html")),
        positions=True,
    ).withColumn("headings", F.array()).select("conv_id", listing.skeleton(body).alias("html"))
    return listing.framed_parts(staged(skeletons), fragments, ["conv_id"])


@query("close_fragments", """
    SELECT conv_id, 1 AS part, turn + conv_id % 3 - 1 AS frag_no,
           CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id)
                THEN '<html><body>' || role || ' ' || turn
                ELSE '<html><body>' || role || ' ' || turn || '</body></html>' END AS html
    FROM conversations
    UNION ALL
    SELECT conv_id, 2, NULL, '</body></html>' FROM conversations GROUP BY conv_id""")
def close_fragments(spark, folder):
    # Page numbers start at -1, 0 or 1.
    page = markup("<html><body>", P("role"), " ", P("turn"), "</body></html>")
    turns = table(spark, folder, "conversations").select(
        "conv_id", (P("turn") + P("conv_id") % 3 - 1).alias("frag_no"), page.alias("html")
    )
    return listing.closed_parts(turns, ["conv_id"])


_SEAM = (
    "chr(10) || chr(10) || '<!-- ============================================= -->' || chr(10)"
    " || '<!-- === APPENDED DATA: TECHNISCHE GEGEVENS TAB === -->' || chr(10)"
    " || '<!-- ============================================= -->' || chr(10) || chr(10)"
)


@query("merge_tabs", f"""
    SELECT o_orderkey, CASE
      WHEN o_orderkey % 5 = 4 THEN '<body>' || o_custkey || '</body>'
      WHEN o_orderkey % 3 = 0 THEN '<body>' || o_custkey || {_SEAM} || chr(10) || o_orderstatus
                                   || chr(10) || '</body>'
      WHEN o_orderkey % 3 = 1 THEN '<body>' || o_custkey || {_SEAM} || '<p>' || o_orderstatus
                                   || chr(10) || '</body>'
      ELSE '<p>' || o_custkey || {_SEAM} || chr(10) || o_orderstatus END AS html
    FROM orders""")
def merge_tabs(spark, folder):
    key = P("o_orderkey")
    orders = table(spark, folder, "orders")
    first = F.when(
        (key % 5 == 4) | (key % 3 != 2), markup("<body>", P("o_custkey"), "</body>")
    ).otherwise(markup("<p>", P("o_custkey")))
    second = F.when(key % 3 == 1, markup("<p>", P("o_orderstatus"))).otherwise(
        markup("<HTML><BODY class=x>\n", P("o_orderstatus"), "</BODY></HTML>")
    )
    pages = orders.select("o_orderkey", first.alias("html"))
    # The same tab may have been landed twice.
    twice = F.explode(F.array_repeat(second, (key % 2 + 1).cast("int")))
    tabs = orders.where(key % 5 != 4).select("o_orderkey", twice.alias("html"))
    return listing.append_tab(pages, tabs, ["o_orderkey"])


@query("listing_state_change", f"""
    WITH t AS (SELECT p_brand, {KEY},
                      CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR)
                           ELSE left(repeat('x', 199) || p_type || 'y', 200) END AS state
               FROM part)
    SELECT p_brand, {KEY}, state,
           state <> lag(state) OVER (PARTITION BY p_brand ORDER BY {KEY}) AS changed
    FROM t""")
def listing_state_change(spark, folder):
    page = F.when(
        P("p_size") % 2 == 0,
        markup("<body>x<product-cards-wrapper product-ids=", P("p_size"), "></body>"),
    ).otherwise(
        markup("<title>no</title><body>", F.repeat(F.lit("x"), F.lit(199)), "<b>", P("p_type"), "</b>y</body>")
    )
    pages = parts(spark, folder).select("p_brand", KEY, page.alias("html"))
    states = parse_pages(pages).withColumn("headings", F.array()).select(
        "p_brand", KEY, listing.listing_state(page_of()).alias("state")
    )
    return listing.page_changed(states, ["p_brand"], KEY, "state")


@query("price_summary", f"""
    SELECT {KEY}, p_size % 4 > 0 AS found, p_size % 4 AS total,
           least(p_size % 4, 1) AS filled
    FROM part""")
def price_summary(spark, folder):
    empty = '<pes-product-price> </pes-product-price>'
    filled = markup('<div class="price"><i>', P("p_retailprice"), "</i></div>")
    n = P("p_size") % 4
    page = F.concat(
        F.when(n > 0, filled).otherwise(F.lit("")),
        F.repeat(F.lit(empty), F.greatest(n - 1, F.lit(0))),
        F.lit("<div class=prices>5</div>"),
    )
    pages = parts(spark, folder).select(KEY, page.alias("html"))
    summary = listing.price_summary(page_of(), listing.PRICE_ELEMENTS["schneider"])
    return (
        parse_pages(pages).withColumn("headings", F.array())
        .select(KEY, summary.alias("s")).select(KEY, "s.found", "s.total", "s.filled")
    )


# --- sinks and stream ---------------------------------------------------------------------------------
@query("latest_by_name", """
    WITH t AS (SELECT page_id, regexp_extract(url, '//([^/?#]*)', 1) AS host FROM pages)
    SELECT host AS name, max(page_id) AS page_id, arg_max(length(html), page_id) AS chars
    FROM t JOIN pages USING (page_id) GROUP BY host""")
def latest_by_name(spark, folder):
    # Files named by host alone: every page of a host overwrites the one before.
    pages = table(spark, folder, "pages").select(
        "page_id",
        F.regexp_extract("url", r"^(https?://[^/?#]*)", 1).alias("url"),
        F.length("html").cast("bigint").alias("chars"),
    )
    named = landed_pages(pages).select(
        "page_id", "chars", F.regexp_extract("url", "//(.*)", 1).alias("name")
    )
    return latest(named, ["name"], ["page_id"])


@query("stream_extract", f"""
    SELECT page_id, 'Any' AS vendor, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
           {sql_clean("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")} AS ad
    FROM pages""")
def stream_extract(spark, folder):
    sites = Sites({"generic": {"name": "Any", "specs": [
        {"type": "attribute", "selector": "html[lang]", "attribute": "lang",
         "target_section": "Page", "target_key": "Lang"},
        {"type": "text", "selector": "div.ad", "target_section": "Page", "target_key": "Ad"},
    ]}})
    place = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    # The table may be one file or a folder of files; a stream reads both by a pattern.
    pages = page_stream(spark, f"{folder}/{{pages.parquet}}")
    schema = extract_documents(pages, sites).schema
    run = stream_documents(pages, f"{place}/out", f"{place}/checkpoint", sites)
    run.awaitTermination()
    out = spark.read.schema(schema).parquet(f"{place}/out")
    return out.select(
        "page_id", "vendor", P("kv")["Page"]["Lang"].alias("lang"),
        P("kv")["Page"]["Ad"].alias("ad"),
    )


@query("stream_upsert", """
    SELECT url AS address, CASE page_id % 2 WHEN 0 THEN '260102' ELSE '260101' END AS run_date,
           page_id, CASE WHEN page_id % 3 = 0 AND page_id % 7 <> 0 THEN 2 ELSE 1 END AS version,
           CASE WHEN page_id % 7 = 0 THEN 2 ELSE 0 END AS dead_letters
    FROM pages""")
def stream_upsert(spark, folder):
    """Pages that are delivered again, changed, or without text, over several batches."""
    place = f"{shared_root(spark)}/upsert-{uuid.uuid4().hex}"
    given = table(spark, folder, "pages").select(
        "page_id", "url", P("page_id").alias("at"),
        F.concat(F.lit('<b id="p'), "page_id", F.lit('">1</b>'), "html").alias("html"),
    )
    changed = given.where("page_id % 3 = 0 OR page_id % 7 = 0").withColumn(
        "html", F.when(P("page_id") % 7 != 0, F.replace("html", F.lit('">1</b>'), F.lit('">2</b>')))
    )
    for frame in (given, changed, changed):  # the second delivery comes twice
        frame.write.mode("append").parquet(f"{place}/in")
    stream = (
        spark.readStream.schema("page_id LONG, url STRING, at LONG, html STRING")
        .option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    )
    sites = Sites({"generic": {"name": "Any", "specs": [
        {"type": "text", "selector": "b", "target_section": "Page", "target_key": "Version"},
        {"type": "attribute", "selector": "b", "attribute": "id", "target_section": "Page",
         "target_key": "Id"},
    ]}})
    day = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-01-02 00:00:00")) - P("at") % 2 * 86_400)
    landing.land_documents(stream, place, day, sites=sites).awaitTermination()
    found = landing.landed_documents(spark, place)
    value = lambda name: F.get_json_object("document", f"$.kv.Page.{name}")
    dead = landing.dead_letters(spark, place).groupBy("address").agg(
        F.count("*").cast("int").alias("dead")
    )
    return found.join(dead, "address", "left").select(
        "address", "run_date", F.substring(value("Id"), 2, 20).cast("long").alias("page_id"),
        value("Version").cast("int").alias("version"), F.coalesce("dead", F.lit(0)).alias("dead_letters"),
    )


# --- what a listing's fragments give together ---------------------------------------------
def _listings(spark, folder, html, specs):
    """Events as fragments of one listing per user."""
    pages = rendering(table(spark, folder, "events").select("user_id", "event_id")).select(
        "user_id", P("event_id").alias("frag_no"), html.alias("html")
    )
    return frags.extract_fragments(pages, F.lit("generic"), ["user_id"], only(*specs))


def _where(test, *parts):
    return F.when(test, markup(*parts)).otherwise(F.lit(""))


@query("fragment_first_match", """
    WITH e AS (SELECT user_id, event_id AS e FROM events),
    a AS (SELECT user_id, min(e) AS e FROM e WHERE e % 4 < 2 GROUP BY user_id),
    d1 AS (SELECT user_id, min(e) AS e FROM e WHERE e % 11 = 3 GROUP BY user_id),
    d2 AS (SELECT user_id, min(e) AS e FROM e WHERE e % 5 = 2 GROUP BY user_id),
    c AS (SELECT user_id, min(e) AS e FROM e WHERE e % 7 < 2 GROUP BY user_id)
    SELECT user_id, 'General' AS section, 'A' AS key, '/e' || e AS value FROM a WHERE e % 4 = 1
    UNION ALL
    SELECT user_id, 'Downloads', 'Sheet',
           coalesce('https://h.test/y' || d1.e, 'https://h.test/x' || d2.e) || '.pdf'
    FROM d1 FULL JOIN d2 USING (user_id)
    UNION ALL
    SELECT user_id, 'Product Info', 'Last', '/i' || max(e) || '.png' FROM e WHERE e % 3 = 0 GROUP BY user_id
    UNION ALL
    SELECT user_id, 'Product Info', 'All', '["' || string_agg('/w' || e, '","' ORDER BY e) || '"]'
    FROM e WHERE e % 6 = 1 GROUP BY user_id
    UNION ALL
    SELECT user_id, 'Downloads', 'T' || e, 'https://www.vega.com/p' || e FROM c WHERE e % 7 = 1""")
def fragment_first_match(spark, folder):
    e = P("event_id")
    page = markup(
        _where(e % 4 == 0, '<a class="k">no address</a>'),
        _where(e % 4 == 1, '<a class="k" href="/e', e, '">x</a>'),
        _where(e % 5 == 2, '<a class="d2" href="/x', e, '.pdf">x</a><a class="d1" href="/no">x</a>'),
        _where(e % 11 == 3, '<a class="d1" href="/y', e, '.pdf">x</a>'),
        _where(e % 3 == 0, '<img class="y" src="/i0"><img class="y" src="/i', e, '.png"><img class="y">'),
        _where(e % 6 == 1, '<img class="w" src="/w', e, '">'),
        _where(e % 7 == 0, '<div class="cards"></div>'),
        _where(
            e % 7 == 1, '<div class="cards"><div class="card"><h3>T', e,
            '</h3><li class="language selected" data-url="/p', e, '"></li></div></div>',
        ),
    )
    found = _listings(spark, folder, page, (
        {"type": "attribute", "selector": ".k", "target_key": "A"},
        {"type": "datasheet_link", "selectors": [".d1", ".d2"], "target_key": "Sheet",
         "base_url": "https://h.test/"},
        {"type": "image", "selectors": ["img.z", "img.y"], "take": "last", "target_key": "Last"},
        {"type": "image", "selector": "img.w", "take": "all", "target_key": "All"},
        {"type": "vega_pdf"},
    ))
    return frags.fragment_kv(found, ["user_id"]).select("user_id", "section", "key", "value")


@query("fragment_list_sections", """
    WITH t AS (
      SELECT user_id, event_id,
             last_value(CASE WHEN event_id % 3 = 0 THEN 'S' || event_id END IGNORE NULLS)
               OVER (PARTITION BY user_id ORDER BY event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM events)
    SELECT user_id, event_id AS frag_no, coalesce(before, 'Unknown') AS section,
           'early' AS key, event_id::VARCHAR AS value FROM t
    UNION ALL
    SELECT user_id, event_id,
           CASE WHEN event_id % 3 = 0 THEN 'S' || event_id ELSE coalesce(before, 'Unknown') END,
           'late', event_id::VARCHAR FROM t
    UNION ALL
    SELECT user_id, event_id, 'Page ' || event_id, 'other', event_id::VARCHAR FROM t""")
def fragment_list_sections(spark, folder):
    """Two list operators, each with a running section of its own headers."""
    e = P("event_id")
    page = markup(
        "<h2>Page ", e, "</h2><ul><li><b>early</b><i>", e, "</i></li></ul>",
        _where(e % 3 == 0, "<h3>S", e, "</h3>"), _where(e % 3 == 1, "<h4> skip THIS </h4>"),
        "<ul><li><b>late</b><i>", e, "</i></li></ul><p><b>other</b><i>", e, "</i></p>",
    )
    found = _listings(spark, folder, page, (
        {"type": "li_split", "skip_texts": ["Skip this"]},
        {"type": "li_split", "items": "p", "section_headers": ["h2"]},
    ))
    return frags.fragment_facts(found, ["user_id"]).select(
        "user_id", "frag_no", "section", "key", "value"
    )


@query("fragment_article_pdf", f"""
    WITH w AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_id % 9 = 4 GROUP BY user_id),
    c AS (SELECT user_id, min(event_id) AS e FROM events WHERE event_id % 13 = 2 GROUP BY user_id),
    n AS (SELECT user_id, coalesce(w.e, c.e)::VARCHAR AS n FROM w FULL JOIN c USING (user_id))
    SELECT user_id, 'https://www.phoenixcontact.com/product/pdf/api/v1/' || to_base64(encode(n))
           || '?_realm=be&_locale=de-DE&blocks=commercial-data%2Ctechnical-data%2Cdrawings%2Capprovals'
           || '%2Cclassifications%2Cenvironmental-compliance-data%2Call-accessories&action=DOWNLOAD'
           AS value
    FROM n""")
def fragment_article_pdf(spark, folder):
    """An article number in one fragment, the operator that reads it in all of them."""
    e = P("event_id")
    page = markup(
        _where(e % 13 == 2, '<link rel="canonical" href="https://h.test/a-', e, '">'),
        "<h2>Other</h2><dl><dt>Artikelnummer</dt><dd>no</dd></dl>",
        _where(e % 9 == 4, "<h2>Productdetails</h2><dl><dt>Artikelnummer</dt><dd>", e, "</dd></dl>"),
    )
    found = _listings(spark, folder, page, ({"type": "dl"}, {"type": "phoenix_pdf", "locale": "de-DE"}))
    facts = frags.fragment_kv(found, ["user_id"])
    return facts.where(P("key") == "PDF Datasheet").select("user_id", "value")


@query("fragment_containers", """
    WITH t AS (
      SELECT user_id, event_id AS e,
             min(event_id) FILTER (event_id % 5 = 1) OVER (PARTITION BY user_id) AS opens
      FROM events),
    u AS (
      SELECT *, min(e) FILTER (e > opens AND (e % 3 = 0 OR e % 5 = 1)) OVER (PARTITION BY user_id) AS closes FROM t)
    SELECT user_id, e AS frag_no, 'early' AS key, e::VARCHAR AS value FROM u
    WHERE opens IS NULL OR (e > opens AND e <= coalesce(closes, e))
    UNION ALL
    SELECT user_id, e, 'late', e::VARCHAR FROM u
    WHERE opens IS NULL OR (e >= opens AND e < coalesce(closes, e + 1))
    UNION ALL
    SELECT user_id, e, 'item ' || e, e::VARCHAR FROM u""")
def fragment_containers(spark, folder):
    """Containers that one fragment opens and another closes; only the first of a listing is read.

    Every fifth fragment opens one, it and every third close the one before: with
    ``main``, the elements left open in it go too.
    """
    e = P("event_id")
    page = markup(
        "<dl><dt>early</dt><dd>", e, "</dd></dl>", _where((e % 3 == 0) | (e % 5 == 1), "</main>"),
        _where(e % 5 == 1, '<main><div class="specs x"><p>'),
        "<dl><dt>late</dt><dd>", e, "</dd></dl><ul><li><b>item ", e, "</b><i>", e, "</i></li></ul>",
    )
    rows = rendering(table(spark, folder, "events").select("user_id", "event_id")).select(
        "user_id", e.alias("frag_no"), page.alias("html")
    )
    sites = only(
        {"type": "dl", "container": "main .specs"}, {"type": "li_split", "container": "article"}
    )
    found = frags.extract_fragments(rows, F.lit("generic"), ["user_id"], sites, pieces=True)
    return frags.fragment_facts(found, ["user_id"]).select("user_id", "frag_no", "key", "value")


@query("stream_state_change", """
    WITH d AS (SELECT user_id, event_id AS e, event_type AS state,
                      CASE WHEN event_id % 10 = 0 THEN 4
                           ELSE 1 + event_id * 3 // (SELECT max(event_id) + 1 FROM events) END AS batch
               FROM events),
    m AS (SELECT *, coalesce(batch = 4 AND e < max(e) FILTER (batch < 4)
                                              OVER (PARTITION BY user_id), false) AS late FROM d),
    t AS (SELECT user_id, e, lag(state) OVER (PARTITION BY user_id ORDER BY e) AS before
          FROM m WHERE NOT late),
    s AS (SELECT user_id, e, lag(state) OVER (PARTITION BY user_id ORDER BY e) AS before FROM d)
    SELECT m.user_id, m.e AS event_id, late,
           CASE WHEN NOT late THEN state <> t.before END AS changed, state <> s.before AS settled
    FROM m JOIN s ON m.user_id = s.user_id AND m.e = s.e
    LEFT JOIN t ON m.user_id = t.user_id AND m.e = t.e""")
def stream_state_change(spark, folder):
    """Events as fragments that come in four deliveries, every tenth in the last."""
    place = f"{shared_root(spark)}/changes-{uuid.uuid4().hex}"
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    many = events.agg(F.max("event_id") + 1).first()[0] or 1
    third = F.floor(P("event_id") * 3 / F.lit(many))
    dealt = events.withColumn("delivery", F.when(P("event_id") % 10 == 0, 3).otherwise(third))
    for number in range(4):
        dealt.where(P("delivery") == number).drop("delivery").write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{place}/in")
        changes.stream_changes(stream, place, ["user_id"], "event_id", "event_type").awaitTermination()
    told = changes.told_changes(spark, place).select("user_id", "event_id", "changed", "late")
    settled = changes.settled_changes(spark, place, ["user_id"], "event_id", "event_type")
    return told.join(
        settled.select("user_id", "event_id", P("changed").alias("settled")), ["user_id", "event_id"]
    )
