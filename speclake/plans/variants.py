"""Product lists as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speclake.operators.page import page_of
from speclake.operators.variants import TEXT_FIELDS, held_record, held_records, variant_records


def variant_rows(parsed: DataFrame, keys: Sequence[str], spec: Mapping) -> DataFrame:
    """One row per card of every page or fragment, numbered in page order.

    Pages come as trees, or with what ``parse_pages(cards=spec)`` found on them.
    """
    if "cards" in parsed.columns:
        held = parsed.select(*keys, F.posexplode_outer(held_records(F.col("cards"))).alias("item_no", "r"))
        record = held_record(F.col("r"), spec.get("base_url", ""))
        return held.where(F.col("item_no").isNotNull()).select(
            *keys, "item_no", *[value.alias(name) for name, value in record.items()]
        )
    names = ("container", "variant_selector", "base_url", "fields")
    records = variant_records(page_of(), **{n: spec[n] for n in names if n in spec})
    return (
        parsed.select(*keys, F.posexplode_outer(records).alias("item_no", "r"))
        .where(F.col("item_no").isNotNull())
        .select(
            *keys, "item_no", *[F.col(f"r.{name}").alias(name) for name in (*TEXT_FIELDS, "specs")]
        )
    )
