"""The rows an extraction operator gives: arrays of hit structs on the page row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = (
    "STRUCT<spec_ord INT, extractor_type STRING, section STRING, key STRING, "
    "value STRING, value_kind STRING, weight INT>"
)
HITS = f"ARRAY<{HIT}>"


def hit(section: Column, key: Column, value: Column, kind: str = "string",
        weight: Column | None = None) -> Column:
    """One write of a value under a section and key.

    ``weight`` is what the write adds to the operator's count; it differs from
    1 where one write holds several items.
    """
    return F.struct(
        section.alias("section"),
        key.alias("key"),
        value.alias("value"),
        F.lit(kind).alias("value_kind"),
        (F.lit(1) if weight is None else weight).cast("int").alias("weight"),
    )


def present(hits: Column) -> Column:
    """Drops hits without key or value."""
    return F.filter(hits, lambda h: (h["key"] != "") & (h["value"] != ""))


def single(section: str, key: str, value: Column, kind: str = "string",
           weight: Column | None = None) -> Column:
    """At most one hit: none when the value is NULL or empty."""
    return F.filter(
        F.array(hit(F.lit(section), F.lit(key), value, kind, weight)),
        lambda h: h["value"] != "",
    )


# The kind of an entry that tells what went wrong instead of writing a value.
ERROR = "error"


def failing(hits: Column, problem: Column) -> Column:
    """Hits with a problem told behind them where there is one.

    What was written before stays, what was counted is lost: the operator ended
    with an error.
    """
    told = F.array(hit(F.lit(""), F.lit(""), problem, ERROR, F.lit(0)))
    uncounted = F.transform(hits, lambda h: h.withField("weight", F.lit(0)))
    return F.when(problem.isNull(), hits).otherwise(F.concat(uncounted, told))


def written(hits: Column) -> Column:
    """Hits that write a value."""
    return F.filter(hits, lambda h: h["value_kind"] != ERROR)


def stamp(hits: Column, spec_ord: int, extractor_type: str) -> Column:
    """Completes hits with the place and type of the operator that made them."""
    return F.transform(
        hits,
        lambda h: F.struct(
            F.lit(spec_ord).alias("spec_ord"),
            F.lit(extractor_type).alias("extractor_type"),
            h["section"].alias("section"),
            h["key"].alias("key"),
            h["value"].alias("value"),
            h["value_kind"].alias("value_kind"),
            h["weight"].alias("weight"),
        ),
    )


def none() -> Column:
    """No hits, in the type that operators return."""
    return F.array().cast(
        "ARRAY<STRUCT<section STRING, key STRING, value STRING, value_kind STRING, weight INT>>"
    )
