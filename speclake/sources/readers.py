"""Where pages and addresses come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speclake.functions.text import strip

URL_TEMPLATE = "# one URL per line\n"


def clean_url_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Addresses without blank lines, notes and outer white space."""
    return lines.withColumn(column, strip(F.col(column))).where(
        (F.col(column) != "") & ~F.startswith(F.col(column), F.lit("#"))
    )


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url, ord) of a URL list; a missing list is created empty."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        out = files.create(target)
        out.write(bytearray(URL_TEMPLATE, "utf-8"))
        out.close()
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return clean_url_lines(lines).select(F.col("value").alias("url"), "ord")


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): one row per landed file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages stored as Parquet; only the needed columns are scanned."""
    return spark.read.parquet(path).select("page_id", "url", "html")
