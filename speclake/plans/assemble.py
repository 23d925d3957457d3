"""Facts to documents: last write wins, counts, cleanup, previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speclake.functions.text import format_stamp, preview
from speclake.functions.urls import result_file_name
from speclake.operators.hits import ERROR, written
from speclake.operators.page import let

KV_COLUMNS = (
    "spec_ord", "extractor_type", "hit_ord", "section", "key", "value", "value_kind", "weight",
)


# --- on the page row -----------------------------------------------------------
def last_writes(hits: Column) -> Column:
    """(section, key) -> (value, kind), in order of first write.

    Relies on ``spark.sql.mapKeyDedupPolicy=LAST_WIN``: a repeated key keeps
    its first place and takes the last value.
    """
    entries = F.transform(
        written(hits),
        lambda h: F.struct(
            F.struct(h["section"].alias("section"), h["key"].alias("key")).alias("key"),
            F.struct(h["value"].alias("value"), h["value_kind"].alias("value_kind")).alias(
                "value"
            ),
        ),
    )
    return F.map_entries(F.map_from_entries(entries))


def kv_map(hits: Column) -> Column:
    """section -> key -> value.

    Empty values go; a section that loses all its values stays as an empty map.
    """

    placed = F.transform(
        last_writes(hits),
        lambda w, i: F.struct(
            w["key"]["section"].alias("section"),
            i.alias("place"),
            w["key"]["key"].alias("key"),
            w["value"]["value"].alias("value"),
        ),
    )

    def entries(group: Column) -> Column:
        kept = F.filter(group, lambda w: w["value"] != "")
        return F.map_from_entries(
            F.transform(kept, lambda w: F.struct(w["key"].alias("key"), w["value"].alias("value")))
        )

    def sections(writes: Column, starts: Column) -> Column:
        def group(start: Column, i: Column) -> Column:
            end = F.coalesce(F.get(starts, i + 1), F.size(writes))
            first = F.get(writes, start)
            return F.struct(
                first["place"].alias("place"),
                first["section"].alias("section"),
                F.slice(writes, start + 1, end - start).alias("writes"),
            )

        # Sections stand in the order of their first writes.
        return let(
            F.sort_array(F.transform(starts, group)),
            lambda gs: F.map_from_arrays(
                F.transform(gs, lambda g: g["section"]),
                F.transform(gs, lambda g: entries(g["writes"])),
            ),
        )

    def borders(writes: Column) -> Column:
        starts = F.filter(
            F.transform(
                writes,
                lambda w, i: F.when(
                    (i == 0) | (F.get(writes, i - 1)["section"] != w["section"]), i
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return let(starts, lambda found: sections(writes, found))

    # Sorted by section, so that each section is one slice: no search per section.
    return let(F.sort_array(placed), borders)


def stats_map(hits: Column) -> Column:
    """Operator type -> items written, repeated keys included; nothing for a type without items."""
    counted = F.filter(hits, lambda h: h["weight"] > 0)
    types = F.array_distinct(F.transform(counted, lambda h: h["extractor_type"]))

    def total(kind: Column) -> Column:
        return F.aggregate(
            F.filter(hits, lambda h: h["extractor_type"] == kind),
            F.lit(0).cast("bigint"),
            lambda total, h: total + h["weight"],
        )

    return let(types, lambda names: F.map_from_arrays(names, F.transform(names, total)))


def documents_from_hits(
    extracted: DataFrame, keys: Sequence[str], extracted_at: Column | None = None
) -> DataFrame:
    """One document per page: vendor, kv, stats, metadata."""
    at = F.current_timestamp() if extracted_at is None else extracted_at
    return extracted.select(
        *keys,
        F.col("vendor_name").alias("vendor"),
        kv_map(F.col("hits")).alias("kv"),
        F.array_distinct(
            F.transform(
                F.filter("hits", lambda h: h["value_kind"] == "json"),
                lambda h: F.struct(h["section"].alias("section"), h["key"].alias("key")),
            )
        ).alias("json_keys"),
        stats_map(F.col("hits")).alias("stats"),
        F.struct(
            F.nullif(F.col("canonical_url"), F.lit("")).alias("canonical_url"),
            format_stamp(at).alias("extraction_timestamp"),
        ).alias("metadata"),
        result_file_name(F.col("canonical_url"), at).alias("file_name"),
        "error",
    )


def kv_raw_from_hits(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per write, numbered in write order.  Errors are no writes, see ``spec_errors``."""
    # The outer form on purpose: for the inner one the optimizer would test the
    # array in a filter below, and so work out all hits a second time.
    return _entries(extracted, keys).where(F.col("h.value_kind") != ERROR).select(
        *keys,
        *[
            F.col("hit_ord") if name == "hit_ord" else F.col(f"h.{name}").alias(name)
            for name in KV_COLUMNS
        ],
    )


def _entries(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return extracted.select(
        *keys, F.posexplode_outer("hits").alias("hit_ord", "h")
    ).where(F.col("hit_ord").isNotNull())


def spec_errors(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The quarantine table of specs: every spec that ended with an error on a page, and why.

    It comes out of the same pass as the facts; the other specs of the page went on.
    """
    return _entries(extracted, keys).where(F.col("h.value_kind") == ERROR).select(
        *keys,
        F.col("h.spec_ord").alias("spec_ord"),
        F.col("h.extractor_type").alias("extractor_type"),
        F.col("h.value").alias("message"),
    )


def kv_from_hits(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per kept (section, key), without a shuffle."""
    return (
        extracted.select(
            *keys, F.posexplode_outer(last_writes(F.col("hits"))).alias("key_ord", "w")
        )
        .where(F.col("key_ord").isNotNull())
        .select(
            *keys,
            F.col("w.key.section").alias("section"),
            F.col("w.key.key").alias("key"),
            F.col("w.value.value").alias("value"),
            F.col("w.value.value_kind").alias("value_kind"),
            "key_ord",
        )
        .where(F.col("value") != "")
    )


# --- on long facts, which may come from several rows per page ---------------------
def last_write(kv_raw: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last value per (section, key) and the order of its first write.

    One shuffle; ``max_by`` and ``min`` combine before it, so a key written
    very often moves one row per task.
    """
    place = F.struct(*order)
    return (
        kv_raw.groupBy(*keys, "section", "key")
        .agg(
            F.max_by(F.struct("value", "value_kind"), place).alias("last"),
            F.min(place).alias("key_ord"),
        )
        .select(*keys, "section", "key", "last.value", "last.value_kind", "key_ord")
        .where(F.col("value") != "")
    )


def stats(kv_raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items per operator type; nothing for a type without items."""
    return kv_raw.where(F.col("weight") > 0).groupBy(*keys, "extractor_type").agg(
        F.sum("weight").cast("bigint").alias("items")
    )


def section_counts(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items per section, with the number of sections of the page."""
    return (
        documents.select(
            *keys,
            F.size("kv").cast("bigint").alias("sections"),
            F.explode_outer("kv").alias("section", "entries"),
        )
        .where(F.col("section").isNotNull())
        .select(*keys, "sections", "section", F.size("entries").cast("bigint").alias("items"))
    )


def preview_documents(
    documents: DataFrame, keys: Sequence[str], sections: int = 3, entries: int = 2
) -> DataFrame:
    """First keys of the first sections of every document, values cut for display."""
    first_sections = F.slice(F.map_entries("kv"), F.lit(1), F.lit(sections))
    first_keys = F.slice(F.map_entries(F.col("s.value")), F.lit(1), F.lit(entries))
    return (
        documents.select(*keys, F.posexplode_outer(first_sections).alias("section_no", "s"))
        .select(
            *keys, "section_no", F.col("s.key").alias("section"),
            F.posexplode_outer(first_keys).alias("key_no", "e"),
        )
        .where(F.col("key_no").isNotNull())
        .select(
            *keys, "section_no", "section", "key_no", F.col("e.key").alias("key"),
            preview(F.col("e.value")).alias("value"),
        )
    )
