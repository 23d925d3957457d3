"""Looking back along an order, with hot keys split into ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 65_536


def with_value_before(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    name: str,
    skip_nulls: bool = False,
    width: int = RANGE,
) -> DataFrame:
    """Adds the value of the row before, per key; the last non-NULL one if asked.

    ``order`` is a whole number, unique within a key.  Each key is cut into
    ranges of ``width`` order values, so a window never holds more than
    ``width`` rows, however many rows a key has.  What crosses a range border
    is one value per range, carried by a second window over the ranges.  There may
    be as many of these as rows, so they are joined by a shuffle, never broadcast.
    """
    own = [*keys, "_range"]
    held = rows.withColumn("_range", F.floor(F.col(order) / F.lit(width))).withColumn(
        "_value", value
    )
    in_order = Window.partitionBy(*own).orderBy(order)
    inner = (
        F.last("_value", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
        if skip_nulls
        else F.lag("_value").over(in_order)
    )
    # Rows without an order value do not count for max_by.
    counted = F.when(F.col("_value").isNotNull(), F.col(order)) if skip_nulls else F.col(order)
    ranges = held.groupBy(*own).agg(
        F.max_by(F.struct(F.col("_value").alias("v")), counted).alias("_end")
    )
    by_range = Window.partitionBy(*keys).orderBy("_range")
    border = (
        F.last("_end", ignorenulls=True).over(
            by_range.rowsBetween(Window.unboundedPreceding, -1)
        )
        if skip_nulls
        else F.lag("_end").over(by_range)
    )
    borders = ranges.select(*own, border.alias("_border")).where(F.col("_border").isNotNull())
    seen = held.withColumn("_inner", inner)
    if skip_nulls:
        found = F.coalesce(F.col("_inner"), F.col("_border.v"))
    else:
        seen = seen.withColumn("_first", F.row_number().over(in_order) == 1)
        found = F.when(F.col("_first"), F.col("_border.v")).otherwise(F.col("_inner"))
    return (
        seen.join(borders.hint("merge"), own, "left")
        .withColumn(name, found)
        .drop("_range", "_value", "_inner", "_first", "_border")
    )
