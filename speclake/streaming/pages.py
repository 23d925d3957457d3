"""Landed pages as a stream.

Extraction is local to a page, so the batch plan runs on a stream unchanged: no
state, no watermark, and the file sink writes every page once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from speclake.plans.extraction import extract_documents
from speclake.sources.sites import Sites

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"


def page_stream(
    spark: SparkSession, path: str, glob: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(PAGE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def stream_documents(
    pages: DataFrame, output: str, checkpoint: str, sites: Sites | None = None, **options
) -> StreamingQuery:
    """Appends the documents of all pages landed so far, then stops."""
    return (
        extract_documents(pages, sites, **options)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
