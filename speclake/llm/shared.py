"""Helpers of this subpackage: shared storage, tables, Arrow rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from speclake.session import shared_root


def prepared(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches small: texts may be long, and a batch is held whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Only in a session of one machine, as in tests, it may be unset.
    """
    return f"{shared_root(spark)}/llm-{uuid.uuid4().hex}"


def staged(rows: DataFrame) -> DataFrame:
    """Writes rows to the shared folder and reads them back.

    What several later steps read is worked out once, and a lost executor
    loses nothing of it.
    """
    folder = shared_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def in_arrow(
    rows: DataFrame,
    step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch],
    schema: T.StructType | str,
) -> DataFrame:
    """Runs ``step`` on every Arrow batch."""

    def run(batches):
        for batch in batches:
            yield from step(batch)

    return rows.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType | str) -> pa.Schema:
    """The Arrow schema of a Spark schema given as text."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    return to_arrow_schema(schema)


class Kept:
    """What was worked out for words met lately.

    Two generations of at most ``most`` words or so: when the young one is full
    it becomes the old one, and words that are met again move up.
    """

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, wanted: set[str], make: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """A dictionary that holds all wanted words."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        missing = wanted.difference(self.young)
        again = missing.intersection(self.old)
        self.young.update((w, self.old[w]) for w in again)
        new = list(missing.difference(again))
        if new:
            self.young.update(zip(new, make(new), strict=True))
        return self.young
