"""Session settings the engine relies on, and settings that suit its plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Needed for right results: repeated JSON keys keep the last value, repeated
# map keys keep the last value, time stamps are read as UTC, and letters are
# lower-cased by the JVM's tables (ICU's may differ, and are much slower).
RESULT_SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.icu.caseMappings.enabled": "false",
}

# A compressed split of page text grows many times when read, and one page is
# the unit of work, so input splits and Arrow batches are kept small.  Facts repeat
# their sections and keys, so they shrink in a shuffle too; a task holds 8 MB of it.
SCALE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(8 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Sets the run-time settings above on an existing session."""
    for name, value in {**RESULT_SETTINGS, **SCALE_SETTINGS}.items():
        spark.conf.set(name, value)
    return spark


def require_settings(spark: SparkSession) -> None:
    """An error that names the settings results depend on, if one is not as it must be."""
    wrong = [n for n, v in RESULT_SETTINGS.items() if (spark.conf.get(n, None) or "").lower() != v.lower()]
    if wrong:
        raise RuntimeError(f"call speclake.session.configure first; not set: {', '.join(wrong)}")


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and tasks share one process, and so its folders."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only in a session of one machine, as in tests, it may be unset; a folder of
    this machine is taken then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not one_machine(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="speclake-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def staged(rows: DataFrame) -> DataFrame:
    """Rows that several later steps read, worked out once and at once.

    They are checkpointed in the shared folder, so nothing is lost with an
    executor; with ``spark.cleaner.referenceTracking.cleanCheckpoints`` the
    files go when the rows are no longer used.
    """
    shared_root(rows.sparkSession)
    return rows.checkpoint()
