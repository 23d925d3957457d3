"""Page changes of listings on a stream.

A fragment of a listing is compared with the one before it (`listing.page_changed`),
which may have come in an earlier micro-batch.  What a listing ended with, one small
row, is the state that is kept: every batch writes the ends of the listings it
touched, every ``WHOLE`` batches all of them, so a batch reads one whole state and
less than ``WHOLE`` parts.  A batch reads states of earlier batches only and writes
folders of its own number, so one that is delivered again changes nothing.  Within a
batch, listings are cut into ranges as everywhere; none meets in one task.

A fragment is *late* if its listing has got past it in an earlier batch.  It is
written with ``late`` and without ``changed``, and moves no state: what has been
told of later fragments stays.  ``settled_changes`` compares all fragments there
are, late ones in their places.  Of fragments of one listing and number the one of
the least state counts; fragments without a number or a listing are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from speclake.operators.listing import page_changed

WHOLE = 16


def _ends_before(spark: SparkSession, place: str, number: int, keys: Sequence[str]) -> DataFrame:
    """The last number and state of all listings, as of the batch before ``number``."""
    last = number - 1
    parts = spark.read.parquet(f"{place}/ends").where(
        (F.col("batch") >= last - last % WHOLE) & (F.col("batch") <= last)
    )
    return parts.groupBy(*keys).agg(F.max("end").alias("end"))


def change_batch(
    batch: DataFrame, number: int, place: str, keys: Sequence[str], order: str, state: str
) -> None:
    """Writes the changes of one batch of fragments and the ends it leaves; again, if it came before."""
    spark, columns = batch.sparkSession, [*keys, order, state]
    placed = batch.select(*columns).dropna(subset=[*keys, order])
    rows = placed.groupBy(*keys, order).agg(F.min(state).alias(state))
    if number:
        before = _ends_before(spark, place, number, keys)
        held = rows.join(before, list(keys), "left").select(*columns, "end")
        known = before.join(rows.select(*keys).distinct(), list(keys), "left_semi").select(
            *keys, F.col("end.at").alias(order), F.col("end.state").alias(state), F.lit(True).alias("_known")
        )
    else:
        held = rows.withColumn("end", F.lit(None).cast("STRUCT<at: BIGINT, state: STRING>"))
        before, known = None, None
    late = F.coalesce(F.col(order) <= F.col("end.at"), F.lit(False))
    marked = held.select(*columns, late.alias("late"))
    timely = marked.where(~F.col("late")).select(*columns, F.lit(False).alias("_known"))
    compared = page_changed(timely if known is None else timely.unionByName(known), keys, order, state)
    told = compared.where(~F.col("_known")).select(*columns, "changed", F.lit(False).alias("late"))
    left = marked.where("late").select(*columns, F.lit(None).cast("boolean").alias("changed"), "late")
    told.unionByName(left).write.mode("overwrite").parquet(f"{place}/changes/batch={number}")
    end = F.struct(F.col(order).cast("bigint").alias("at"), F.col(state).alias("state"))
    ends = timely.groupBy(*keys).agg(F.max(end).alias("end"))
    if before is not None and number % WHOLE == 0:
        ends = ends.unionByName(before).groupBy(*keys).agg(F.max("end").alias("end"))
    ends.write.mode("overwrite").parquet(f"{place}/ends/batch={number}")


def stream_changes(
    fragments: DataFrame, place: str, keys: Sequence[str], order: str, state: str
) -> StreamingQuery:
    """Tells the changes of all fragments there are so far, then stops; the checkpoint lies beside them."""
    return (
        fragments.writeStream.foreachBatch(
            lambda batch, number: change_batch(batch, number, place, keys, order, state)
        )
        .option("checkpointLocation", f"{place}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def told_changes(spark: SparkSession, place: str) -> DataFrame:
    """What the stream has told: per fragment its state, ``changed`` and ``late``."""
    return spark.read.parquet(f"{place}/changes").drop("batch")


def settled_changes(spark: SparkSession, place: str, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """The changes of all fragments there are, late ones in their places."""
    told = told_changes(spark, place).groupBy(*keys, order).agg(F.min(state).alias(state))
    return page_changed(told, keys, order, state)
