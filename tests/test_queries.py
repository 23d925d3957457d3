"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from catalogue.base import QUERIES, SQL
from tests.compare import differences, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    names, rows = spark_rows(QUERIES[name](spark, FOLDER))
    sql = SQL.get(name)
    if sql is None:
        assert sum(rows.values()) > 0
        return
    want_names, want = sql_rows(FOLDER, sql)
    assert names == want_names
    assert rows == want, differences(rows, want)


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r.vendor for r in rows} > {"Siemens", "VEGA", "Generic"}
