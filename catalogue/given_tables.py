"""Queries that run on the given tables as they are."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalogue.base import (
    SQL_MARKUP,
    SQL_WORD,
    query,
    sql_clean,
    sql_entities,
    table,
)
from speclake.functions import json_paths, text, urls
from speclake.operators import classify
from speclake.operators.listing import page_changed, page_class
from speclake.operators.page import page_of
from speclake.operators.parse import parse_pages
from speclake.operators.selectors import tags
from speclake.plans import extraction
from speclake.plans.assemble import kv_from_hits
from speclake.sources.sinks import crawl_records
from speclake.sources.sites import Sites


def parsed_pages(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extraction.read_trees(pages)


# --- text and addresses -------------------------------------------------------------
@query(
    "clean_documents",
    f"SELECT doc_id, {sql_clean('text')} AS cleaned FROM documents",
)
def clean_documents(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", text.clean_text(F.col("text")).alias("cleaned")
    )


@query(
    "plain_documents",
    r"""SELECT doc_id,
          trim(regexp_replace(regexp_replace(text, '[\n\r\t]+|\\[nrt]', ' ', 'g'),
                              '[\s\x{a0}]{2,}', ' ', 'g')) AS plain,
          trim(regexp_replace(replace(replace(text, '<br />', chr(10)), '<br>', chr(10)),
                              '<[^>]+>', '', 'g'), ' ' || chr(10) || chr(9) || chr(13)) AS untagged
        FROM documents""",
)
def plain_documents(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        text.clean_plain_text(F.col("text")).alias("plain"),
        text.strip_tags(F.col("text")).alias("untagged"),
    )


@query(
    "conversation_openings",
    f"""WITH t AS (
          SELECT conv_id, turn, role, {sql_clean('text')} AS cleaned,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
          FROM conversations)
        SELECT conv_id, turn, role,
               CASE WHEN length(cleaned) > 50 THEN left(cleaned, 50) || '...'
                    ELSE cleaned END AS opening
        FROM t WHERE n <= 2""",
)
def conversation_openings(spark, folder):
    turns = table(spark, folder, "conversations")
    # A rank limit is applied before the shuffle too, so long conversations
    # move two rows per task.
    first = Window.partitionBy("conv_id").orderBy("turn")
    return (
        turns.withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= 2)
        .select(
            "conv_id", "turn", "role",
            text.preview(text.clean_text(F.col("text"))).alias("opening"),
        )
    )


_SQL_HOST = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)"
_SQL_PATH = (
    "trim(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), '/')"
)


@query(
    "page_file_names",
    f"""WITH t AS (SELECT page_id, replace({_SQL_HOST}, 'www.', '') AS host, {_SQL_PATH} AS path
                   FROM pages)
        SELECT page_id,
               regexp_replace(left(regexp_replace(
                 CASE WHEN path <> '' THEN host || '_' || path ELSE host END,
                 '[^{SQL_WORD}\\-.]', '_', 'g'), 200), '[_.]+$', '') || '.html' AS file_name
        FROM t""",
)
def page_file_names(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", urls.page_file_name(F.col("url")).alias("file_name"))


@query(
    "result_file_names",
    f"""SELECT page_id,
               '240131_' || left(regexp_replace(
                 regexp_replace(url, 'https?://(www\\.)?', '', 'g'),
                 '[^{SQL_WORD}\\-]', '_', 'g'), 100) || '.json' AS file_name
        FROM pages""",
)
def result_file_names(spark, folder):
    pages = table(spark, folder, "pages")
    run_date = F.lit("2024-01-31").cast("date")
    return pages.select("page_id", urls.result_file_name(F.col("url"), run_date).alias("file_name"))


@query(
    "url_site_class",
    f"""WITH t AS (SELECT page_id, lower({_SQL_HOST}) AS host FROM pages)
        SELECT page_id,
               CASE WHEN contains(host, 'siemens') THEN 'siemens'
                    WHEN contains(host, 'phoenixcontact') THEN 'phoenix'
                    WHEN contains(host, 'se.com') OR contains(host, 'schneider-electric')
                      THEN 'schneider'
                    ELSE 'other' END AS site
        FROM t""",
)
def url_site_class(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", urls.site_class(F.col("url")).alias("site"))


_HOST_MARKS = (("spam-farm", "spam"), ("blog.", "blog"), ("example.com", "com"),
               ("example.net", "net"))


@query(
    "vendor_by_url",
    """SELECT page_id,
              CASE WHEN contains(lower(url), 'spam-farm') THEN 'spam'
                   WHEN contains(lower(url), 'blog.') THEN 'blog'
                   WHEN contains(lower(url), 'example.com') THEN 'com'
                   WHEN contains(lower(url), 'example.net') THEN 'net'
                   ELSE NULL END AS vendor
       FROM pages""",
)
def vendor_by_url(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select(
        "page_id", classify.site_by_address(F.col("url"), _HOST_MARKS).alias("vendor")
    )


@query(
    "article_pdf_url",
    """SELECT p_partkey,
              'https://www.phoenixcontact.com/product/pdf/api/v1/'
              || base64(encode(CAST(p_partkey AS VARCHAR)))
              || '?_realm=be&_locale=nl-BE&blocks=commercial-data%2Ctechnical-data%2Cdrawings'
              || '%2Capprovals%2Cclassifications%2Cenvironmental-compliance-data'
              || '%2Call-accessories&action=DOWNLOAD' AS pdf_url
       FROM part""",
)
def article_pdf_url(spark, folder):
    parts = table(spark, folder, "part")
    return parts.select(
        "p_partkey",
        urls.article_pdf_url(F.col("p_partkey").cast("string")).alias("pdf_url"),
    )


@query(
    "address_functions",
    """WITH t AS (
         SELECT p_partkey, CASE p_partkey % 6
           WHEN 0 THEN '/product/pdf/' || p_partkey
           WHEN 1 THEN 'http://h.test/x-' || p_partkey || '.PDF'
           WHEN 2 THEN '//cdn.test/' || p_partkey
           WHEN 3 THEN 'docs/datenblatt/' || p_partkey
           WHEN 4 THEN '../up/' || p_partkey
           ELSE '?q=' || p_partkey END AS url
         FROM part)
       SELECT p_partkey,
              p_partkey % 6 IN (0, 1, 3) AS is_datasheet,
              CASE p_partkey % 6
                WHEN 0 THEN 'https://www.nexans.be' || url
                WHEN 1 THEN url
                WHEN 2 THEN 'https:' || url
                WHEN 3 THEN 'https://www.nexans.be/' || url
                WHEN 4 THEN 'https://www.nexans.be/up/' || p_partkey
                ELSE 'https://www.nexans.be' || url END AS absolute,
              CASE p_partkey % 6
                WHEN 0 THEN 'https://www.vega.com' || url
                WHEN 2 THEN 'https://www.vega.com' || url ELSE url END AS prefixed,
              CASE p_partkey % 6 WHEN 0 THEN 'B' || url WHEN 1 THEN url
                WHEN 2 THEN 'B' || url ELSE 'B/' || url END AS based
       FROM t""",
)
def address_functions(spark, folder):
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 6
    url = (
        F.when(kind == 0, F.concat(F.lit("/product/pdf/"), key))
        .when(kind == 1, F.concat(F.lit("http://h.test/x-"), key, F.lit(".PDF")))
        .when(kind == 2, F.concat(F.lit("//cdn.test/"), key))
        .when(kind == 3, F.concat(F.lit("docs/datenblatt/"), key))
        .when(kind == 4, F.concat(F.lit("../up/"), key))
        .otherwise(F.concat(F.lit("?q="), key))
    )
    rows = table(spark, folder, "part").select("p_partkey", url.alias("url"))
    u = F.col("url")
    return rows.select(
        "p_partkey",
        urls.is_datasheet_url(u).alias("is_datasheet"),
        urls.absolute_url(u, "https://www.nexans.be").alias("absolute"),
        urls.prefix_by_name(u, "VEGA").alias("prefixed"),
        urls.prefix_base(u, "B").alias("based"),
    )


# --- events -------------------------------------------------------------------------
@query(
    "event_prop_path",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
              CAST(NULL AS VARCHAR) AS missing FROM events""",
)
def event_prop_path(spark, folder):
    rows = table(spark, folder, "events")
    props = F.try_parse_json("props")
    return rows.select(
        "event_id",
        json_paths.path_get(props, "k", "bigint").alias("k"),
        json_paths.path_get(props, "k.deeper", "string").alias("missing"),
    )


@query(
    "event_stamp",
    "SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S') AS stamp FROM events",
)
def event_stamp(spark, folder):
    rows = table(spark, folder, "events")
    return rows.select("event_id", text.format_stamp(F.col("ts")).alias("stamp"))


@query(
    "state_change",
    """SELECT user_id, event_id,
              event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)
                AS changed
       FROM events""",
)
def state_change(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    return page_changed(rows, ["user_id"], "event_id", "event_type").select(
        "user_id", "event_id", "changed"
    )


# --- page structure -------------------------------------------------------------------
@query(
    "tag_counts",
    f"""SELECT page_id, tag, count(*) AS n
        FROM (SELECT page_id, unnest(regexp_extract_all(
                regexp_replace({SQL_MARKUP}, '<!DOCTYPE[^>]*>', '')
                || repeat('<script>', len(regexp_extract_all(html, '<script')))
                || repeat('<style>', len(regexp_extract_all(html, '<style'))),
                '<([a-z][a-z0-9]*)', 1)) AS tag
              FROM pages)
        GROUP BY page_id, tag""",
)
def tag_counts(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "html")
    # Counts are combined before the shuffle, so few rows are sent.
    return (
        parse_pages(pages, want=("nodes",))
        .select("page_id", F.explode("nodes.tag").alias("tag"))
        .groupBy("page_id", "tag")
        .agg(F.count("*").alias("n"))
    )


def _links(parsed, rule):
    page = page_of()
    found = F.transform(
        page.select(rule),
        lambda a: F.struct(a["attrs"]["href"].alias("href"), page.text(a).alias("label")),
    )
    return (
        parsed.select("page_id", F.posexplode_outer(found).alias("n", "a"))
        .where(F.col("n").isNotNull())
        .select("page_id", F.col("n").cast("bigint").alias("n"), "a.href", "a.label")
    )


@query(
    "page_links",
    f"""WITH t AS (SELECT page_id, regexp_extract_all({SQL_MARKUP}, '<a href="([^"]*)"', 1) AS hs,
                          regexp_extract_all({SQL_MARKUP}, '<a href="[^"]*">([^<]*)', 1) AS ls
                   FROM pages)
        SELECT page_id, i - 1 AS n, {sql_entities('hs[i]')} AS href,
               {sql_clean(sql_entities('ls[i]'))} AS label
        FROM (SELECT *, unnest(generate_series(1, len(hs))) AS i FROM t)""",
)
def page_links(spark, folder):
    return _links(parsed_pages(spark, folder), "a[href]")


@query(
    "nav_links",
    f"""WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav
                   FROM pages),
             u AS (SELECT page_id, regexp_extract_all(nav, '<a href="([^"]*)"', 1) AS hs,
                          regexp_extract_all(nav, '<a href="[^"]*">([^<]*)', 1) AS ls FROM t)
        SELECT page_id, i - 1 AS n, {sql_entities('hs[i]')} AS href,
               {sql_clean(sql_entities('ls[i]'))} AS label
        FROM (SELECT *, unnest(generate_series(1, len(hs))) AS i FROM u)""",
)
def nav_links(spark, folder):
    return _links(parsed_pages(spark, folder), "nav ul a, nav a[title]")


_SQL_TITLE = sql_clean(sql_entities("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
_SQL_H1 = sql_clean(sql_entities("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))


@query(
    "crawl_records",
    f"""SELECT page_id, url, '2024-01-31T10:11:12.000000' AS scraped_at, {_SQL_TITLE} AS title,
               CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS keywords,
               CAST(NULL AS VARCHAR) AS og_title, CAST(NULL AS VARCHAR) AS og_description,
               url || '#end' AS final_url, length(html) AS html_length, TRUE AS success
        FROM pages""",
)
def crawl(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    # The length is taken before the parse, so the text is handed over once.
    sized = pages.withColumn("length", F.length("html").cast("bigint"))
    records = crawl_records(
        parse_pages(sized, want=("nodes", "texts", "error")),
        page_of(),
        F.col("url"),
        F.lit("2024-01-31 10:11:12").cast("timestamp"),
        html_length=F.col("length"),
        final_url=F.concat("url", F.lit("#end")),
        keys=("page_id",),
    )
    return records.select(
        "page_id", "url", "scraped_at", "metadata.title", "metadata.description",
        "metadata.keywords", "metadata.og_title", "metadata.og_description",
        "metadata.final_url", "html_length", "success",
    )


@query(
    "page_attributes",
    f"""SELECT page_id, 'Page' AS section, k AS key,
               CASE k WHEN 'Lang' THEN regexp_extract(html, '<html lang="([^"]*)"', 1)
                      WHEN 'Charset' THEN regexp_extract(html, '<meta charset="([^"]*)"', 1)
                      ELSE {sql_clean("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")}
               END AS value
        FROM pages, (VALUES ('Lang'), ('Charset'), ('Ad')) AS ks(k)""",
)
def page_attributes(spark, folder):
    sites = Sites({
        "generic": {
            "name": "Any",
            "specs": [
                {"type": "attribute", "selector": "html[lang]", "attribute": "lang",
                 "target_section": "Page", "target_key": "Lang"},
                {"type": "attribute", "selector": "head meta", "attribute": "charset",
                 "target_section": "Page", "target_key": "Charset"},
                {"type": "attribute", "selector": "h1", "attribute": "nowhere",
                 "target_section": "Page", "target_key": "None"},
                {"type": "text", "selector": "div.ad",
                 "target_section": "Page", "target_key": "Ad"},
            ],
        },
    })
    pages = table(spark, folder, "pages").select("page_id", "html")
    hits = extraction.extract_pages(pages, sites)
    return kv_from_hits(hits, ["page_id"]).select("page_id", "section", "key", "value")


@query(
    "paragraph_sections",
    f"""WITH t AS (SELECT page_id, {_SQL_H1} AS h1,
                          len(regexp_extract_all({SQL_MARKUP}, '<p>')) AS ps FROM pages)
        SELECT page_id, i - 1 AS n, h1 AS section
        FROM (SELECT *, unnest(generate_series(1, ps)) AS i FROM t)""",
)
def paragraph_sections(spark, folder):
    page = page_of()
    found = F.transform(page.select(tags("p")), page.section)
    return (
        parsed_pages(spark, folder)
        .select("page_id", F.posexplode_outer(found).alias("n", "section"))
        .where(F.col("n").isNotNull())
        .select("page_id", F.col("n").cast("bigint").alias("n"), "section")
    )


_PAGE_SITES = {
    "long_menu": {"priority": 5, "detect": [{"selector": "nav li:nth-of-type(8)"}]},
    "french": {"priority": 10, "detect": [{"id": "nowhere"}, {"selector": "html[lang='fr']"}]},
    "german": {"priority": 10, "detect": [{"selector": "html[lang*='d']"}]},
    "wordy": {"detect": [{"text_contains": "NICHT"}, {"text_contains": "Para"}]},
    "plain": {"priority": 500, "detect": [{"class_contains": "d"}]},
    "generic": {"priority": 999, "detect": [{"always": True}]},
}

_SQL_TEXT = f"lower(regexp_replace({SQL_MARKUP}, '<[^>]*>', '', 'g'))"


@query(
    "vendor_first_match",
    f"""SELECT page_id, CASE
          WHEN len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li>')) >= 8
            THEN 'long_menu'
          WHEN contains(html, '<html lang="fr"') THEN 'french'
          WHEN contains(html, '<html lang="de"') THEN 'german'
          WHEN contains(html, 'class="ad"') THEN 'plain'
          WHEN contains({_SQL_TEXT}, 'nicht') OR contains({_SQL_TEXT}, 'para') THEN 'wordy'
          ELSE 'generic' END AS vendor
        FROM pages""",
)
def vendor_first_match(spark, folder):
    decided = classify.site_of_page(page_of(), Sites(_PAGE_SITES))
    return parsed_pages(spark, folder).select("page_id", decided.alias("vendor"))


@query(
    "vendor_by_text",
    f"""SELECT page_id, CASE
          WHEN contains({_SQL_TEXT}, 'nicht') OR contains({_SQL_TEXT}, 'para') THEN 'wordy'
          WHEN contains({_SQL_TEXT}, 'que') THEN 'que'
          ELSE 'generic' END AS vendor
        FROM pages""",
)
def vendor_by_text(spark, folder):
    sites = Sites({
        "wordy": {"priority": 1, "detect": [{"text_contains": "NICHT"}, {"text_contains": "Para"}]},
        "que": {"priority": 2, "detect": [{"class_contains": "zzz"}, {"text_contains": "que"}]},
    })
    decided = classify.site_of_page(page_of(), sites)
    return parsed_pages(spark, folder).select("page_id", decided.alias("vendor"))


@query(
    "page_list_class",
    """SELECT page_id, CASE WHEN page_id % 4 IN (0, 1, 2) THEN 'list' ELSE 'detail' END AS class
       FROM pages""",
)
def page_list_class(spark, folder):
    # The given pages with an address and a mark of the landing rules.
    kind = F.col("page_id") % 4
    url = (
        F.when(kind == 0, F.lit("https://www.se.com/product-range/1"))
        .when(kind == 1, F.lit("https://www.phoenixcontact.com/x"))
        .when(kind == 2, F.lit("https://mall.industry.siemens.com/x"))
        .otherwise(F.lit("https://www.se.com/x"))
    )
    mark = (
        F.when(kind == 1, F.lit('<div id="se-result"></div>'))
        .when(kind == 2, F.lit('<label for="listView">List</label>'))
        .otherwise(F.lit(""))
    )
    pages = table(spark, folder, "pages").select(
        "page_id", url.alias("url"), F.concat("html", mark).alias("html")
    )
    return parse_pages(pages).withColumn("headings", F.array()).select(
        "page_id", page_class(page_of(), F.col("url")).alias("class")
    )
