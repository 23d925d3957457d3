"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclake.llm.shared import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node; the root is the least node it reaches.

    Turns of a large and a small star: each node's greater neighbours go to its
    least one, then its lesser ones.  A node's neighbours are never gathered,
    only their least is, and links are written to the shared folder each turn.
    """
    now = staged(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u > v")
        .distinct()
    )
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(own, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(own.withColumnRenamed("m", "v"))
            .distinct()
        )
        now = staged(small)
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )


def _mark(links: DataFrame) -> tuple:
    found = links.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
    ).first()
    return tuple(found)
