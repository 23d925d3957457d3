"""Where pages and results go.

All sinks append; a later run of the same day and file name is newer, and
``latest`` keeps the newest.  Nothing has to be rewritten in place, and a task
that is run again cannot leave half a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speclake.functions.urls import page_file_name
from speclake.operators.page import Page
from speclake.operators.selectors import tags


def latest(rows: DataFrame, name: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """Newest row per name; ``newest`` tells the rows of a name apart.

    Winners are found on the narrow columns, combined before the shuffle.  Rows
    are then matched by name and ``newest`` together, so a name shared by very
    many rows (pages without an address) is no hot key.
    """
    winners = (
        rows.groupBy(*name)
        .agg(F.max(F.struct(*newest)).alias("newest"))
        .select(*name, "newest.*")
    )
    return rows.join(winners, [*name, *newest], "left_semi")


def json_values(kv: Column, kinds: Column | None = None) -> Column:
    """kv as sections of JSON values: text stays text, stored JSON is JSON again."""

    def value(section: Column, key: Column, text: Column) -> Column:
        quoted = F.try_variant_get(F.try_parse_json(F.to_json(F.array(text))), "$[0]", "variant")
        if kinds is None:
            return quoted
        return F.when(
            F.array_contains(kinds, F.struct(section.alias("section"), key.alias("key"))),
            F.try_parse_json(text),
        ).otherwise(quoted)

    return F.transform_values(
        kv, lambda section, entries: F.transform_values(
            entries, lambda key, text: value(section, key, text)
        )
    )


def document_json(documents: DataFrame, *more: str) -> DataFrame:
    """(run_date, url, file_name, document) and the columns ``more``: one JSON text per page."""
    document = F.struct(
        "vendor",
        json_values(F.col("kv"), F.col("json_keys")).alias("kv"),
        "stats",
        "metadata",
    )
    return documents.select(
        F.left("file_name", F.lit(6)).alias("run_date"),
        F.col("metadata.canonical_url").alias("url"),
        "file_name",
        F.to_json(document).alias("document"),
        *more,
    )


def write_documents(documents: DataFrame, path: str, written_at: Column | None = None) -> None:
    """Appends the documents with their address and the time of this write."""
    at = F.current_timestamp() if written_at is None else written_at
    documents_of = document_json(documents).withColumn("written_at", at)
    documents_of.write.mode("append").partitionBy("run_date").json(path)


WRITTEN = "run_date STRING, url STRING, file_name STRING, document STRING, written_at TIMESTAMP"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents as they stand: of one day and page the one written last.

    A page is its full address, as different pages may share a file name; pages
    without an address are told apart by file name only, as when each write
    replaces the file before.
    """
    written = spark.read.schema(WRITTEN).json(path)
    # Of two documents of one time either will do, so a hash of the text decides.
    named = written.withColumns(
        {"page": F.coalesce("url", "file_name"), "mark": F.xxhash64("document")}
    )
    newest = latest(named, ["run_date", "page"], ["written_at", "mark"])
    return newest.dropDuplicates(["run_date", "page"]).drop("page", "mark")


def landed_pages(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("file_name", page_file_name(F.col(url)))


def write_pages(pages: DataFrame, path: str, url: str = "url") -> None:
    landed_pages(pages, url).write.mode("append").parquet(path)


def page_metadata(page: Page) -> Column:
    """Title and description fields of a page."""

    def meta(attribute: str, value: str) -> Column:
        return page.first(f"meta[{attribute}='{value}']")["attrs"]["content"]

    return F.struct(
        page.first_text(tags("title")).alias("title"),
        meta("name", "description").alias("description"),
        meta("name", "keywords").alias("keywords"),
        meta("property", "og:title").alias("og_title"),
        meta("property", "og:description").alias("og_description"),
    )


def crawl_records(
    parsed: DataFrame, page: Page, url: Column, scraped_at: Column,
    html: Column | None = None, html_length: Column | None = None,
    final_url: Column | None = None, keys: Sequence[str] = (),
) -> DataFrame:
    """One record per landed page, as the crawl documents it, with the page's keys.

    The record holds the page text if ``html`` is given; its length alone can
    be taken before the parse.
    """
    meta = page_metadata(page)
    text = [] if html is None else [html.alias("html")]
    length = F.length(html) if html_length is None else html_length
    return parsed.select(
        *keys,
        url.alias("url"),
        F.date_format(scraped_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("scraped_at"),
        F.struct(
            meta["title"].alias("title"),
            url.alias("url"),
            (url if final_url is None else final_url).alias("final_url"),
            meta["description"].alias("description"),
            meta["keywords"].alias("keywords"),
            meta["og_title"].alias("og_title"),
            meta["og_description"].alias("og_description"),
        ).alias("metadata"),
        *text,
        length.alias("html_length"),
        F.col("error").isNull().alias("success"),
    )
