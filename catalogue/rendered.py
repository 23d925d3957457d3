"""Round trips: product pages rendered from the given tables, then extracted.

The SQL reads the source table and never sees a page, so it cannot share a
mistake with the extraction.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.base import markup, query, rendering, table
from speclake.functions import json_paths
from speclake.plans import assemble, extraction
from speclake.session import shared_root
from speclake.sources.sinks import document_json, read_documents, write_documents
from speclake.sources.sites import Sites, load_sites

KEY = "p_partkey"


def parts(spark, folder) -> DataFrame:
    return rendering(table(spark, folder, "part"))


def only(*specs: dict, name: str = "Any") -> Sites:
    """Sites with one entry, which takes every page."""
    return Sites({"generic": {"name": name, "specs": list(specs)}})


def built_in(vendor: str) -> Sites:
    """The built-in specs of one site, for pages known to be of that site."""
    site = load_sites().spec_source(vendor)
    return Sites({"generic": {"name": site.name, "specs": list(site.specs)}})


def hits(pages: DataFrame, sites: Sites) -> DataFrame:
    return extraction.extract_pages(pages, sites, vendor=F.lit("generic"))


def kv(pages: DataFrame, sites: Sites, key: str = KEY) -> DataFrame:
    return assemble.kv_from_hits(hits(pages, sites), [key]).select(key, "section", "key", "value")


P = F.col


def table_page():
    return markup(
        '<html><head><link rel="canonical" href="https://mall.industry.siemens.com/p/',
        P(KEY), '"></head><body><h2>', P("p_brand"),
        '</h2><table class="TEPreviewTable"><tr class="hc"><td>K</td><td>V</td></tr>'
        "<tr><td>Name</td><td> ", P("p_name"), "\n</td></tr><tr><td>Size</td><td><b>",
        P("p_size"), "</b></td><td>more</td></tr><tr><td>Alone</td></tr></table></body></html>",
    )


TABLE_KV = f"""
    SELECT {KEY}, p_brand AS section, 'Name' AS key, p_name AS value FROM part
    UNION ALL
    SELECT {KEY}, p_brand, 'Size', CAST(p_size AS VARCHAR) FROM part"""


# --- pairs of labels and values ---------------------------------------------------------
@query("table_kv", TABLE_KV)
def table_kv(spark, folder):
    pages = parts(spark, folder).select(KEY, table_page().alias("html"))
    return kv(pages, built_in("siemens"))


@query("nested_table_writes", f"""
    SELECT {KEY}, 'Unknown' AS section, 'Inner' AS key, p_name AS value, 2 AS writes FROM part
    UNION ALL
    SELECT {KEY}, 'Unknown', 'Outer', 'Inner ' || p_name || ' Inner', 1 FROM part""")
def nested_table_writes(spark, folder):
    page = markup(
        "<table><tr><td>Outer</td><td><table><tr><th>Inner</th><td>", P("p_name"),
        "</td></tr></table>Inner</td></tr></table>",
    )
    pages = parts(spark, folder).select(KEY, page.alias("html"))
    sites = only({"type": "table", "container": ".nowhere"})
    facts = assemble.kv_raw_from_hits(hits(pages, sites), [KEY])
    return facts.groupBy(KEY, "section", "key").agg(
        F.max("value").alias("value"), F.count("*").cast("int").alias("writes")
    )


@query("dl_kv", f"""
    SELECT {KEY}, p_type AS section, 'Brand' AS key, p_brand AS value FROM part
    UNION ALL
    SELECT {KEY}, p_type, 'Size', CAST(p_size AS VARCHAR) FROM part""")
def dl_kv(spark, folder):
    # The second list is out of the container, its last term has no description.
    page = markup(
        '<div class="specifications"><h3>', P("p_type"), "</h3><dl><dt>Brand</dt><dd>",
        P("p_brand"), "</dd><dt>Size</dt><dd>", P("p_size"),
        "</dd><dt>Rest</dt></dl></div><dl><dt>No</dt><dd>no</dd></dl>",
    )
    pages = parts(spark, folder).select(KEY, page.alias("html"))
    return kv(pages, only({"type": "dl", "container": ".specifications"}))


@query("rows_kv", f"""
    SELECT {KEY}, 'Unknown' AS section, 'Size' AS key,
           CAST(p_size AS VARCHAR) || ' | ' || p_type AS value FROM part""")
def rows_kv(spark, folder):
    page = markup(
        '<div class="characteristic"><span class="characteristic-title">Size</span>'
        '<li class="characteristic-value">', P("p_size"), '<i class="unit-choice">mm</i></li>'
        '<li class="characteristic-value"> </li><li class="characteristic-value">', P("p_type"),
        "</li></div><div class=characteristic><b>no key</b></div>",
    )
    pages = parts(spark, folder).select(KEY, page.alias("html"))
    return kv(pages, built_in("vega"))


@query("rows_one_value", f"""
    SELECT {KEY}, p_brand AS section, p_name AS key, CAST(p_size AS VARCHAR) AS value
    FROM part""")
def rows_one_value(spark, folder):
    page = markup(
        "<h4>", P("p_brand"), '</h4><h5> </h5><ul><li><p class="commercial-data-section__subtitle">',
        P("p_name"), "</p><p>", P("p_size"), "</p><p>later</p></li><li>none</li></ul>",
    )
    pages = parts(spark, folder).select(KEY, page.alias("html"))
    return kv(pages, only(load_sites().spec_source("siemens").specs[1]))


@query("list_kv", f"""
    SELECT {KEY}, p_brand AS section, 'Type' AS key, p_type || ' x' AS value FROM part
    UNION ALL
    SELECT {KEY}, 'Unknown', 'Early', CAST(p_size AS VARCHAR) FROM part""")
def list_kv(spark, folder):
    page = markup(
        "<h3>Outside</h3><div id=specifications><li><i>Early</i>", P("p_size"), "</li><h3>",
        P("p_brand"), "</h3><h4>Technical Data</h4><ul><li><b>Type</b><span>", P("p_type"),
        "\nx</span></li><li>single</li></ul></div>",
    )
    pages = parts(spark, folder).select(KEY, page.alias("html"))
    return kv(pages, built_in("siemens"))


@query("label_kv", f"""
    SELECT {KEY}, p_brand AS section, 'Size' AS key, CAST(p_size AS VARCHAR) AS value FROM part
    UNION ALL
    SELECT {KEY}, p_brand, 'Type', p_type FROM part
    UNION ALL
    SELECT {KEY}, p_brand, 'ab: b', p_name FROM part""")
def label_kv(spark, folder):
    return kv(_label_pages(spark, folder), built_in("generic"))


def _label_pages(spark, folder):
    page = markup(
        "<h2>", P("p_brand"), "</h2><p>Size: ", P("p_size"), "</p><div><p>Type: ", P("p_type"),
        "</p></div><span>k: short</span><span>ab: b: ", P("p_name"), "</span>",
    )
    return parts(spark, folder).select(KEY, page.alias("html"))


@query("extract_stats", f"SELECT {KEY}, 'label_value' AS extractor_type, 4 AS items FROM part")
def extract_stats(spark, folder):
    facts = assemble.kv_raw_from_hits(
        hits(_label_pages(spark, folder), built_in("generic")), [KEY]
    )
    return assemble.stats(facts, [KEY]).withColumn("items", F.col("items").cast("int"))


# --- one hit per page -----------------------------------------------------------------------
@query("meta_text_attr", f"""
    SELECT {KEY}, 'Product Info' AS section, 'Description' AS key, p_name AS value FROM part
    UNION ALL
    SELECT {KEY}, 'Product Info', 'Image URL', 'https://www.vega.com/img/' || {KEY} || '.png'
    FROM part WHERE p_size % 2 = 0
    UNION ALL
    SELECT {KEY}, 'Product Info', 'Text', p_type || ' a b' FROM part""")
def meta_text_attr(spark, folder):
    # On odd sizes the first image has no address, and the second does not count.
    image = F.when(
        P("p_size") % 2 == 0, markup('<img alt="a VEGA b" src="/img/', P(KEY), '.png">')
    ).otherwise(F.lit('<img alt="VEGA"><img alt="VEGA" src="/no.png">'))
    page = markup(
        '<meta name="description" content=" ', P("p_name"), ' "><div class="cbp-item">', image,
        '</div><div class="product-application-text">', P("p_type"),
        "\n<b>a\\tb</b></div><div class=product-application-text>second</div>",
    )
    sites = only(
        {"type": "meta_description", "target_section": "Product Info"},
        {"type": "attribute", "selector": "div.cbp-item img[alt*='VEGA']", "attribute": "src",
         "target_section": "Product Info", "target_key": "Image URL",
         "post_process": "prepend_base_url"},
        {"type": "text", "selector": "div.product-application-text",
         "target_section": "Product Info", "target_key": "Text"},
        name="VEGA",
    )
    return kv(parts(spark, folder).select(KEY, page.alias("html")), sites)


@query("datasheet_link", f"""
    SELECT {KEY}, 'Downloads' AS section, 'Datasheet' AS key,
           CASE {KEY} % 3 WHEN 0 THEN 'https://www.nexans.be/product/pdf/' || {KEY}
                          WHEN 1 THEN 'https://cdn.test/' || {KEY} || '.pdf'
                          ELSE 'https://www.nexans.be/f/' || {KEY} || '.PDF' END AS value
    FROM part""")
def datasheet_link(spark, folder):
    kind = P(KEY) % 3
    plain = markup('<a href="/x.html">a</a><a href="/product/pdf/', P(KEY), '">b</a>')
    marked = markup(
        plain, '<a class="product__downloads__file__link" data-ga-type="datasheet" '
        'href="https://cdn.test/', P(KEY), '.pdf">c</a>',
    )
    by_text = markup(
        '<a href="/no.pdf">manual</a><a href="/yes.html">datasheet</a><a href="f/', P(KEY),
        '.PDF">the <b>Fiche</b>\n technique</a>',
    )
    page = F.when(kind == 0, plain).when(kind == 1, marked).otherwise(by_text)
    spec = load_sites().spec_source("nexans").specs[2]
    return kv(parts(spark, folder).select(KEY, page.alias("html")), only(spec))


@query("image_select", f"""
    SELECT {KEY}, 'Product Info' AS section, k AS key,
           CASE k WHEN 'First' THEN '/a/' || {KEY} WHEN 'Last' THEN '/b/' || {KEY}
                  WHEN 'All' THEN '["/a/' || {KEY} || '","/b/' || {KEY} || '"]'
                  ELSE 'https://i.test/' || {KEY} END AS value
    FROM part, (VALUES ('First'), ('Last'), ('All'), ('Data')) AS ks(k)""")
def image_select(spark, folder):
    page = markup(
        '<script type="application/ld+json">{bad</script><script type="application/ld+json">'
        '{"z":[{"note":"x"},{"w":{"image":{"url":""}}}],"a":{"b":{"image":["https://i.test/',
        P(KEY), '"]}},"image":[]}</script><img class=p><img class=p src="/a/', P(KEY),
        '"><img class=p src="/b/', P(KEY), '">',
    )
    specs = [
        {"type": "image", "selectors": [".none", "img.p"], "take": take, "target_key": key}
        for take, key in (("first", "First"), ("last", "Last"), ("all", "All"))
    ]
    specs.append({"type": "image", "selector": ".none", "target_key": "Data",
                  "fallback_jsonld": True})
    return kv(parts(spark, folder).select(KEY, page.alias("html")), only(*specs))


# --- embedded JSON -----------------------------------------------------------------------------
@query("model_json", f"""
    SELECT {KEY}, 'Product Info' AS section, k AS key,
           CASE k WHEN 'Product ID' THEN CAST({KEY} + 1 AS VARCHAR) WHEN 'Product Name' THEN p_name
                  WHEN 'Image URL' THEN 'https://i.test/' || {KEY}
                  ELSE 'https://search.abb.com/library/Download.aspx?DocumentID=D' || {KEY}
                       || '&LanguageCode=en&DocumentPartId=&Action=Launch' END AS value
    FROM part, (VALUES ('Product ID'), ('Product Name'), ('Image URL'), ('Datasheet PDF')) AS ks(k)
    UNION ALL
    SELECT {KEY}, p_brand, 'Size', CAST(p_size AS VARCHAR) || ' / ' || p_type FROM part
    UNION ALL
    SELECT {KEY}, p_brand, 'Bare', p_name FROM part
    UNION ALL
    SELECT {KEY}, 'Specifications', 'DatSheTecInf', 'second' FROM part""")
def model_json(spark, folder):
    page = markup(
        '<script>var a = 1; var model = {"name":"not this","ProductViewModel":{"Product":'
        '{"attributeGroups":{"items":[{"description":"Hidden","visible":false,"attributes":'
        '{"DatSheTecInf":{"values":[{"text":"no","link":{"documentId":"no"}}]}}},{"description":"',
        P("p_brand"), '","visible":true,"attributes":{"S":{"attributeName":"Size","values":'
        '[{"text":"', P("p_size"), '"},{"text":""},{"text":"', P("p_type"), '"}]},'
        '"I":{"isInternal":true,"values":[{"text":"no"}]},"Bare":{"values":["', P("p_name"),
        '"]},"E":{"values":[]},"DatSheTecInf":{"isInternal":true,"values":[{"text":"no","link":'
        '{"documentId":"D', P(KEY), '"}}]}}},{"attributes":{"DatSheTecInf":{"values":[{"text":'
        '"second","link":{"documentId":"no"}}]}}}]}}}};</script>'
        '<script type="application/ld+json">{"@type":"Thing","sku":"no"}</script>'
        '<script type="application/ld+json">{"@type":"Product","sku":', P(KEY) + 1, ',"name":"',
        P("p_name"), '","image":[{"url":"","masterUrl":"https://i.test/', P(KEY), '"}]}</script>',
    )
    return kv(parts(spark, folder).select(KEY, page.alias("html")), built_in("abb"))


@query("attribute_json", f"""
    SELECT {KEY}, 'Product Info' AS section, 'Product ID' AS key, CAST({KEY} AS VARCHAR) AS value
    FROM part
    UNION ALL
    SELECT {KEY}, 'Product Info', 'Description', p_name || ' it''s ' || p_type FROM part
    UNION ALL
    SELECT {KEY}, 'Variants', 'Available',
           '[{{"productId":"' || {KEY} || '-a"}},{{"productId":"' || {KEY} || '-b"}}]' FROM part
    UNION ALL
    SELECT {KEY}, p_brand, 'Size', CAST(p_size AS VARCHAR) FROM part
    UNION ALL
    SELECT {KEY}, 'Specifications', 'Line', p_type || chr(10) || 'b' FROM part
    UNION ALL
    SELECT {KEY}, 'Metadata', 'breadcrumbs', '["a","' || p_type || '"]' FROM part""")
def attribute_json(spark, folder):
    page = markup(
        "<div plain-all-data='{\"base\":{\"productId\":\"\",\"productCR\":\"", P(KEY),
        '","variants":{"chars":[{"productId":"', P(KEY), '-a","x":1},{"x":2},{"productId":"',
        P(KEY), '-b"}]}},"specifications":{"longDescSentences":["', P("p_name"),
        "\",null,\"it&#39;s <i>", P("p_type"), '</i>"],"characteristicTables":[{"tableName":"',
        P("p_brand"), '","rows":[{"characteristicName":"Size","characteristicValues":'
        '[{"labelText":"<b>', P("p_size"), '</b>"},{"labelText":"no"}]},{"characteristicName":'
        '"Empty","characteristicValues":[]}]},{"rows":[{"characteristicName":"Line",'
        '"characteristicValues":[{"labelText":"', P("p_type"), '<br />b"}]}]}]},"breadcrumbs":'
        '["a","', P("p_type"), "\"]}'></div>",
    )
    return kv(parts(spark, folder).select(KEY, page.alias("html")), built_in("schneider"))


@query("image_cascade", f"""
    SELECT {KEY}, CASE {KEY} % 5
        WHEN 0 THEN 'https://download.schneider-electric.com/files?p_Doc_Ref=D' || {KEY}
                    || '&p_File_Type=rendition_369_jpg'
        ELSE 'https://i.test/' || {KEY} || '_rendition_369_jpg?p_Doc_Ref=1' END AS image
    FROM part""")
def image_cascade(spark, folder):
    kind = P(KEY) % 5
    address = markup(
        "https://i.test/", P(KEY),
        "_rendition_1500_jpg?p_Doc_Ref=1&default_image=DefaultProductImage.png",
    )
    late = markup(
        '<div class="mobile-media__slide-360" style="color:red;background:url(', address, ')"></div>'
    )
    slide = markup(late, '<div class="mobile-media__slide"><p><img src="', address, '"></p></div>')
    image = markup('<div class="zoom__viewer"></div>', '<img class="zoom__img" src="', address, '">')
    viewer = markup(
        '<div class="zoom__viewer" style="background-image: url(&quot;', address, '&quot;)"></div>'
        '<img class="zoom__img" src="no">',
    )
    source = markup(
        "<script>x='//download.schneider-electric.com/files?p_Doc_Ref=D", P(KEY),
        "&amp;p_File_Type=rendition_1500_jpg'</script>", viewer,
    )
    page = (
        F.when(kind == 0, source).when(kind == 1, viewer).when(kind == 2, image)
        .when(kind == 3, slide).otherwise(late)
    )
    pages = parts(spark, folder).select(
        KEY, markup("<div plain-all-data='{\"a\":1}'></div>", page).alias("html")
    )
    return kv(pages, built_in("schneider")).where(P("key") == "Image URL").select(
        KEY, P("value").alias("image")
    )


@query("json_merge", f"""
    SELECT {KEY}, p_name AS name, CAST(p_size AS VARCHAR) AS size, p_type AS mended,
           CAST(NULL AS VARCHAR) AS broken, p_brand AS second
    FROM part""")
def json_merge(spark, folder):
    left = markup('{"name":"no","size":', P("p_size"), ',"list":[{"b":"x"},{"b":"', P("p_brand"), '"}]}')
    right = markup('{"name":"', P("p_name"), '"}')
    escaped = markup('{\\"a\\":\\"', P("p_type"), '\\"}')
    documents = F.array(F.try_parse_json(left), F.try_parse_json(right))

    def at(path):
        return json_paths.as_text(json_paths.merged_path(documents, path))

    return parts(spark, folder).select(
        KEY,
        at("name").alias("name"),
        at("size").alias("size"),
        json_paths.path_get(json_paths.repair_escapes(escaped), "a", "string").alias("mended"),
        json_paths.as_text(json_paths.repair_escapes(F.concat(escaped, F.lit("{")))).alias("broken"),
        at("list[1].b").alias("second"),
    )


@query("json_repair", f"""
    SELECT {KEY}, '{{"a":"it\\\\u0027s \\\\d \\"' || p_name || '\\" & <b>","size":' || p_size || '}}'
             AS mended, p_size AS size FROM part""")
def json_repair(spark, folder):
    raw = markup(
        '{"a":"it\\\'s \\d \\\\"', P("p_name"), '\\" &amp; &lt;b&gt;","size":', P("p_size"), "}"
    )
    mended = json_paths.repair_attribute_text(raw)
    return parts(spark, folder).select(
        KEY,
        mended.alias("mended"),
        json_paths.path_get(F.try_parse_json(mended), "size", "int").alias("size"),
    )


# --- downloads -------------------------------------------------------------------------------------
_PDF_TAIL = (
    "?_realm=be&_locale=en-BE&blocks=commercial-data%2Ctechnical-data%2Cdrawings%2Capprovals"
    "%2Cclassifications%2Cenvironmental-compliance-data%2Call-accessories&action=DOWNLOAD"
)


@query("article_pdf", f"""
    SELECT {KEY}, 'https://www.phoenixcontact.com/product/pdf/api/v1/'
             || base64(encode(CASE WHEN {KEY} % 2 = 0 THEN '7' || {KEY}
                                   ELSE CAST({KEY} AS VARCHAR) END))
             || '{_PDF_TAIL}' AS pdf_url
    FROM part WHERE {KEY} % 5 <> 3 OR {KEY} % 2 = 0""")
def article_pdf(spark, folder):
    # Even keys have the number in a table, the others in the address; one
    # address in five does not end in a number.
    end = F.when(P(KEY) % 5 == 3, F.lit("x/")).otherwise(F.lit("//"))
    rows = F.when(
        P(KEY) % 2 == 0,
        markup('<h2>Productdetails</h2><div class="productdetails"><table><tr><td>Artikelnummer'
               "</td><td>7", P(KEY), "</td></tr></table></div>"),
    ).otherwise(F.lit(""))
    page = markup(
        '<link rel="alternate" href="no-1"><link rel="nofollow canonical" '
        'href="https://www.phoenixcontact.com/nl-be/x-', P(KEY), end, '">', rows,
    )
    pages = parts(spark, folder).select(KEY, page.alias("html"))
    return kv(pages, built_in("phoenix")).where(P("key") == "PDF Datasheet").select(
        KEY, P("value").alias("pdf_url")
    )


@query("document_cards", """
    SELECT s_suppkey, 'Downloads' AS section, 'Sheet' || s_name AS key,
           CASE s_suppkey % 3 WHEN 0 THEN 'https://www.vega.com/d/' || s_suppkey
                              WHEN 1 THEN 'https://d.test/' || s_suppkey
                              ELSE 'https://www.vega.com/d/' || s_suppkey END AS value
    FROM supplier""")
def document_cards(spark, folder):
    kind = P("s_suppkey") % 3
    address = (
        F.when(kind == 0, markup("/d/", P("s_suppkey")))
        .when(kind == 1, markup("https://d.test/", P("s_suppkey")))
        .otherwise(markup("d/", P("s_suppkey")))
    )
    page = markup(
        '<div class="cards"><div class="card"><h3>Sheet <b> ', P("s_name"),
        ' </b></h3><ul><li class="language" data-url="/no"></li><li class="language selected" '
        'data-url=" ', address, ' "></li></ul></div><div class="card"><h3>None</h3></div>'
        '<div class="card"><li class="language selected" data-url="/no"></li></div></div>'
        '<div class="cards"><div class="card"><h3>Second</h3><li class="language selected" '
        'data-url="/no"></li></div></div>',
    )
    pages = rendering(table(spark, folder, "supplier")).select("s_suppkey", page.alias("html"))
    # The runs of a title are stripped one by one and joined without a space.
    return kv(pages, built_in("vega"), "s_suppkey")


# --- documents ------------------------------------------------------------------------------------
@query("documents_json", f"""
    SELECT {KEY},
           '240131_mall_industry_siemens_com_p_' || {KEY} || '.json' AS file_name,
           '{{"vendor":"Siemens","kv":{{"' || p_brand || '":{{"Name":"' || p_name || '","Size":"'
           || p_size || '"}}}},"stats":{{"table":2}},"metadata":{{"canonical_url":'
           || '"https://mall.industry.siemens.com/p/' || {KEY}
           || '","extraction_timestamp":"31/01/2024 10:11:12"}}}}' AS document
    FROM part""")
def documents_json(spark, folder):
    pages = parts(spark, folder).select(KEY, table_page().alias("html"))
    documents = extraction.extract_documents(
        pages, built_in("siemens"), F.lit("2024-01-31 10:11:12").cast("timestamp"),
        vendor=F.lit("generic"),
    )
    return document_json(documents).select(
        F.regexp_extract("file_name", r"p_(\d+)", 1).cast("bigint").alias(KEY),
        "file_name", "document",
    )


_LONG = "https://mall.industry.siemens.com/" + "x" * 90 + "/"


@query("latest_documents", f"""
    SELECT {KEY}, '{_LONG}' || {KEY} AS url, CAST(p_size + 1 AS VARCHAR) AS size FROM part""")
def latest_documents(spark, folder):
    """Written twice and read back; the addresses share their first 100 characters."""
    path = f"{shared_root(spark)}/documents-{uuid.uuid4().hex}"
    at = F.lit("2024-01-31 10:11:12").cast("timestamp")
    for run in (1, 0):  # the newer one first
        page = markup(
            '<link rel="canonical" href="' + _LONG, P(KEY), '"><b class="s">', P("p_size") + run, "</b>"
        )
        spec = {"type": "text", "selector": "b.s", "target_section": "S", "target_key": "Size"}
        pages = parts(spark, folder).select(KEY, page.alias("html"))
        documents = extraction.extract_documents(pages, only(spec), at, vendor=F.lit("generic"))
        write_documents(documents, path, at + F.make_interval(mins=F.lit(run)))
    found = read_documents(spark, path)
    return found.select(
        F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias(KEY), "url",
        F.get_json_object("document", "$.kv.S.Size").alias("size"),
    )


def _overwrite_sites():
    sizes = [
        {"type": "attribute", "selector": rule, "attribute": "v",
         "target_section": "S", "target_key": "Size"}
        for rule in ("i.first", "i.second")
    ]
    name = {"type": "text", "selector": "b", "target_section": "S", "target_key": "Name"}
    return only(sizes[0], name, {"type": "no such operator"}, sizes[1])


@query("kv_last_write", f"""
    SELECT {KEY}, 'Size' AS key, CAST(p_size + 1 AS VARCHAR) AS value, 0 AS place FROM part
    UNION ALL SELECT {KEY}, 'Name', p_name, 1 FROM part""")
def kv_last_write(spark, folder):
    return _overwritten(spark, folder, narrow=True)


@query("kv_last_write_shuffled", f"""
    SELECT {KEY}, 'Size' AS key, CAST(p_size + 1 AS VARCHAR) AS value, 0 AS place FROM part
    UNION ALL SELECT {KEY}, 'Name', p_name, 1 FROM part""")
def kv_last_write_shuffled(spark, folder):
    return _overwritten(spark, folder, narrow=False)


def _overwritten(spark, folder, narrow):
    page = markup(
        '<b>', P("p_name"), '</b><i class=first v=', P("p_size"), "></i><i class=second v=",
        P("p_size") + 1, "></i>",
    )
    pages = parts(spark, folder).select(KEY, page.alias("html"))
    extracted = hits(pages, _overwrite_sites())
    if narrow:
        found = assemble.kv_from_hits(extracted, [KEY])
        return found.select(KEY, "key", "value", P("key_ord").cast("int").alias("place"))
    facts = assemble.kv_raw_from_hits(extracted, [KEY])
    found = assemble.last_write(facts, [KEY], ("spec_ord", "hit_ord"))
    return found.select(KEY, "key", "value", P("key_ord.spec_ord").cast("int").alias("place"))


@query("section_counts", f"""
    SELECT {KEY}, 4 AS sections, s AS section, CASE s WHEN 'S1' THEN 3 ELSE 1 END AS items
    FROM part, (VALUES ('S1'), ('S2'), ('S3'), ('S4')) AS ss(s)""")
def section_counts(spark, folder):
    counts = assemble.section_counts(_sectioned(spark, folder), [KEY])
    return counts.select(
        KEY, P("sections").cast("int").alias("sections"), "section",
        P("items").cast("int").alias("items"),
    )


@query("preview_topk", f"""
    SELECT {KEY}, s AS section, k AS key,
           CASE k WHEN 'a' THEN repeat('x', 50) || '...' WHEN 'b' THEN p_name
                  ELSE CAST(p_size AS VARCHAR) END AS value
    FROM part, (VALUES ('S1', 'a'), ('S1', 'b'), ('S2', 'd'), ('S3', 'e')) AS ss(s, k)""")
def preview_topk(spark, folder):
    found = assemble.preview_documents(_sectioned(spark, folder), [KEY])
    return found.select(KEY, "section", "key", "value")


def _sectioned(spark, folder):
    page = markup(
        "<h1>S1</h1><dl><dt>a<dd>", F.repeat(F.lit("x"), F.lit(60)), "</dl></dl><dl><dt>b</dt><dd>",
        P("p_name"), "</dd><dt>c</dt><dd>no</dd></dl><h1>S2</h1><dl><dt>d</dt><dd>", P("p_size"),
        "</dd></dl><h1>S3</h1><dl><dt>e</dt><dd>", P("p_size"),
        "</dd></dl><h1>S4</h1><dl><dt>f</dt><dd>no</dd></dl>",
    )
    page = F.replace(page, F.lit("<dt>a<dd>"), F.lit("<dt>a</dt><dd>"))
    pages = parts(spark, folder).select(KEY, page.alias("html"))
    return extraction.extract_documents(
        pages, only({"type": "dl"}), vendor=F.lit("generic")
    )


@query("nested_rows_noise", f"""
    SELECT {KEY}, 'Outer' AS key, p_name AS value FROM part
    UNION ALL
    SELECT {KEY}, 'Inner', CASE {KEY} % 2 WHEN 0 THEN 'second ' ELSE 'first ' END || p_size FROM part""")
def nested_rows_noise(spark, folder):
    """What an outer row takes out is gone for the row in it."""
    noise = F.when(P(KEY) % 2 == 0, F.lit("noise")).otherwise(F.lit("plain"))
    page = markup(
        '<div class="row"><b>Outer</b><u>', P("p_name"), '</u><div class="row"><p class="', noise,
        '"><b>Inner</b></p><b>Inner</b><p class="', noise, '"><u>first ', P("p_size"), "</u></p><u>second ",
        P("p_size"), "</u></div></div>",
    )
    pages = parts(spark, folder).select(KEY, page.alias("html"))
    spec = {"type": "rows", "rows": ".row", "key": "b", "value": "u", "remove_noise": [".noise"]}
    return kv(pages, only(spec)).select(KEY, "key", "value")


# --- all sites at once -------------------------------------------------------------------------------
_MIXED = f"""CASE {KEY} % 9
    WHEN 0 THEN 'ABB' WHEN 1 THEN 'Siemens' WHEN 2 THEN 'Siemens' WHEN 3 THEN 'VEGA'
    WHEN 4 THEN 'Schneider Electric' WHEN 5 THEN 'Phoenix Contact' WHEN 6 THEN 'Siemens'
    WHEN 7 THEN 'Schneider Electric' ELSE 'Generic' END"""


def mixed_pages(spark, folder):
    kind = P(KEY) % 9
    mark = (
        F.when(kind == 0, F.lit('<link rel="canonical" href="https://new.ABB.com/x">'))
        .when(kind == 1, F.lit('<link rel=canonical href="https://mall.industry.siemens.com/x">'))
        .when(kind == 2, F.lit('<div id="specifications"></div>'))
        .when(kind == 3, F.lit('<b class="x my-characteristic-title-y"></b>'))
        .when(kind == 4, F.lit("<div class=x></div>"))
        .when(kind == 5, F.lit("<p>By PHOENIX \n\n</p>  <p>Contact</p><p>Phoenix Contact</p>"))
        .when(kind == 6, F.lit('<b class="characteristic-title"></b><i id="specifications"></i>'))
        .when(kind == 7, F.lit('<link rel="canonical" href="https://house.com/x">'))
        .otherwise(F.lit('<link rel="canonical"><script>"phoenix contact"</script>'))
    )
    held = F.when(
        kind.isin(4, 7),
        markup("<div plain-all-data='{\"dataSheetTitle\":\"", P("p_name"), "\"}'></div>"),
    ).otherwise(F.lit(""))
    # Every page has something to read for every site.
    page = markup(
        '<html><meta name="description" content=" ', P("p_name"),
        '"><script type="application/ld+json">{"@type":"Product","name":"', P("p_name"),
        '"}</script><body>', mark, held, "<h2>", P("p_name"), "</h2><p>Size: ",
        P("p_size"), '</p><div class="product-application-text">', P("p_name"),
        "</div></body></html>",
    )
    return parts(spark, folder).select(KEY, page.alias("html"))


@query("vendor_mixed", f"SELECT {KEY}, {_MIXED} AS vendor FROM part")
def vendor_mixed(spark, folder):
    extracted = extraction.extract_pages(mixed_pages(spark, folder))
    return extracted.select(KEY, P("vendor_name").alias("vendor"))


@query("mixed_facts", f"""
    WITH t AS (SELECT *, {_MIXED} AS vendor FROM part)
    SELECT {KEY}, vendor,
           CASE vendor WHEN 'Generic' THEN p_name WHEN 'Schneider Electric' THEN 'Metadata'
                       ELSE 'Product Info' END AS section,
           CASE vendor WHEN 'Generic' THEN 'Size' WHEN 'Schneider Electric' THEN 'dataSheetTitle'
                       WHEN 'ABB' THEN 'Product Name' ELSE 'Description' END AS key,
           CASE vendor WHEN 'Generic' THEN CAST(p_size AS VARCHAR) ELSE p_name END AS value
    FROM t""")
def mixed_facts(spark, folder):
    extracted = extraction.extract_pages(mixed_pages(spark, folder))
    return assemble.kv_from_hits(
        extracted, [KEY, "vendor_name"]
    ).select(KEY, P("vendor_name").alias("vendor"), "section", "key", "value")


@query("site_specs", """
    WITH sites(vendor, site_name, specs) AS (VALUES
           ('siemens', 'Siemens', 7), ('vega', 'VEGA', 4), ('nexans', 'Nexans', 3),
           ('phoenix', 'Phoenix Contact', 6), ('abb', 'ABB', 1),
           ('schneider', 'Schneider Electric', 2), ('generic', 'Generic', 4))
    SELECT s_suppkey, coalesce(a.site_name, g.site_name) AS site_name,
           coalesce(a.specs, g.specs) AS specs
    FROM supplier
    LEFT JOIN sites a ON a.vendor = CASE s_suppkey % 3 WHEN 0 THEN 'siemens' WHEN 1 THEN 'abb'
                                                       ELSE 'unknown' END
    JOIN sites g ON g.vendor = 'generic'""")
def site_specs(spark, folder):
    # Site configuration as tables; its size is that of the site file.
    sites = load_sites()
    counts = sites.specs(spark).groupBy("vendor").agg(F.count("*").cast("int").alias("specs"))
    config = F.broadcast(
        sites.vendors(spark).join(counts, "vendor").withColumnRenamed("name", "site_name")
    )
    kind = P("s_suppkey") % 3
    vendor = (
        F.when(kind == 0, F.lit("siemens")).when(kind == 1, F.lit("abb"))
        .otherwise(F.lit("unknown"))
    )
    known = [s.vendor for s in sites.all()]
    entry = F.when(vendor.isin(known), vendor).otherwise(F.lit("generic"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", entry.alias("vendor"))
    return suppliers.join(config, "vendor").select("s_suppkey", "site_name", "specs")


# --- page text that came escaped, and lists of addresses -----------------------------------------------
@query("decode_escaped", TABLE_KV)
def decode_escaped(spark, folder):
    plain = table_page()
    hexed = F.replace(F.replace(plain, F.lit("<"), F.lit("\\x3C")), F.lit(">"), F.lit("\\x3E"))
    entities = F.replace(F.replace(plain, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.when(P(KEY) % 2 == 0, hexed).otherwise(entities)
    pages = parts(spark, folder).select(KEY, page.alias("html"))
    return kv(pages, built_in("siemens"))


@query("url_list", f"SELECT 'https://u.test/' || {KEY} AS url FROM part WHERE {KEY} % 4 IN (0, 3)")
def url_list(spark, folder):
    from speclake.sources.readers import clean_url_lines

    kind = P(KEY) % 4
    address = markup("https://u.test/", P(KEY))
    line = (
        F.when(kind == 0, address).when(kind == 1, F.lit(" \t"))
        .when(kind == 2, markup("  # note ", P(KEY)))
        .otherwise(markup("  ", address, " \r"))
    )
    return clean_url_lines(parts(spark, folder).select(line.alias("url")), "url")
