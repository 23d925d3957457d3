from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from speclake.session import configure

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def extract(spark):
    """(spec or specs, {name: page}) -> {name: [(section, key, value), ...]} in write order."""
    from pyspark.sql import functions as F

    from speclake.plans import extraction
    from speclake.sources.sites import Sites

    def run(specs, pages: dict[str, str], name: str = "Any"):
        specs = [specs] if isinstance(specs, dict) else list(specs)
        sites = Sites({"generic": {"name": name, "specs": specs}})
        frame = spark.createDataFrame(list(pages.items()), "name STRING, html STRING")
        rows = extraction.extract_pages(frame, sites, vendor=F.lit("generic")).collect()
        return {
            row.name: [(h.section, h.key, h.value) for h in row.hits] for row in rows
        }

    return run
