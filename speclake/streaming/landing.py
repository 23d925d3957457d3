"""Incremental landing: documents of a page stream, one per run day and address.

Every micro-batch is written to a folder of its own number.  A batch that is
delivered again (after a failure, a stream does that) replaces just that folder,
so nothing is there twice.  The table as it stands has, of one run day and
address, the row of the latest batch: pages that come again, changed or not,
replace their document, as files of one name do.  Rows are never updated in
place, so a lost executor costs its tasks only, and readers never meet half a
batch.

Pages without text and pages that could not be read are dead letters: they are
landed with the reason in the same pass, and replace nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from speclake.plans.extraction import extract_documents
from speclake.sources.sinks import document_json, latest
from speclake.sources.sites import Sites

LANDED = (
    "run_date STRING, address STRING, url STRING, file_name STRING, document STRING, error STRING, "
    "place LONG, batch LONG"
)
KEY = ("run_date", "address")
NO_TEXT = "no page text"


def landed_rows(
    pages: DataFrame, at: Column, url: str = "url", sites: Sites | None = None, html: str = "html", **options
) -> DataFrame:
    """One row per page: its document, or the error that made it a dead letter.

    ``at`` is the time of the page's run, a column of the pages: the run day must
    be the same when a batch is delivered again.
    """
    held = pages.select(
        F.col(url).alias("_url"), at.alias("_at"), F.monotonically_increasing_id().alias("_place"),
        (F.coalesce(F.trim(html), F.lit("")) == "").alias("_empty"), html,
    )
    documents = extract_documents(held, sites, extracted_at=F.col("_at"), html=html, **options)
    # A page is its canonical address, else the address it was fetched from.
    written = document_json(documents, "_url", "_at", "_place", "_empty", "error")
    missing = F.when(F.col("_empty"), F.lit(NO_TEXT))
    return written.select(
        F.date_format("_at", "yyMMdd").alias("run_date"),
        F.coalesce("url", "_url", "file_name").alias("address"),
        "url",
        "file_name",
        "document",
        F.coalesce("error", missing).alias("error"),
        F.col("_place").alias("place"),
    )


def land_batch(batch: DataFrame, number: int, place: str, at: Column, **options) -> None:
    """Lands one batch of pages; again, if it was landed before."""
    landed_rows(batch, at, **options).write.mode("overwrite").parquet(f"{place}/landed/batch={number}")


def land_documents(pages: DataFrame, place: str, at: Column, **options) -> StreamingQuery:
    """Lands the documents of all pages there are so far, then stops.

    The stream's checkpoint lies beside what it lands, as both tell batches by
    the same numbers.
    """
    return (
        pages.writeStream.foreachBatch(lambda batch, number: land_batch(batch, number, place, at, **options))
        .option("checkpointLocation", f"{place}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def _landed(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.schema(LANDED).parquet(f"{place}/landed")


def landed_documents(spark: SparkSession, place: str) -> DataFrame:
    """The documents as they stand: of one run day and address the one landed last."""
    good = _landed(spark, place).where("error IS NULL")
    return latest(good, list(KEY), ["batch", "place"]).drop("error")


def dead_letters(spark: SparkSession, place: str) -> DataFrame:
    """Pages without a document, and why; pages that came again as often as they came."""
    return _landed(spark, place).where("error IS NOT NULL").drop("document")
