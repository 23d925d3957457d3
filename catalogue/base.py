"""Registration of queries with their SQL, and table access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speclake.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` gives the same rows over the same tables."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(configure(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Rows of a task that renders and reads pages, and merges what it found.
RENDERED = 50_000


def rendering(rows: DataFrame, *columns: str) -> DataFrame:
    """Narrow rows that are about to be rendered as pages, dealt out evenly.

    A row grows a hundred times when it becomes a page, so rows are dealt out
    while they are narrow, and never by a key.  Every core gets a part; a part
    has about ``RENDERED`` rows at most, so that a task's memory does not grow
    with the table.
    """
    chosen = rows.select(*columns) if columns else rows
    parts = -(-chosen.count() // RENDERED)
    return chosen.repartition(max(parts, chosen.sparkSession.sparkContext.defaultParallelism))


def markup(*parts: str | Column) -> Column:
    """Page text from literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# White space and word characters for patterns in the SQL.
SQL_SPACE = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}"
)
SQL_WORD = r"\p{L}\p{M}\p{N}_"


def sql_clean(text: str) -> str:
    """SQL for cleaned text."""
    marks = r"\\(?:[tn]|x3C!----(?:>|&gt;))|<!--(?s:.*?)-->"
    return (
        f"trim(regexp_replace(regexp_replace({text}, '{marks}', ' ', 'g'), "
        f"'[{SQL_SPACE}]+', ' ', 'g'))"
    )


# Page text without what is never text, for counting in SQL.
SQL_MARKUP = (
    r"regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', "
    r"'', 'g')"
)


def sql_entities(text: str) -> str:
    """The entities that occur in the given pages."""
    for name, value in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"),
                        ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{value}')"
    return text
