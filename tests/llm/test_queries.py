"""Queries with SQL against it; the others against brute force in the files beside."""

from __future__ import annotations

import pytest

from speclake.llm.queries import QUERIES, SQL
from tests.compare import differences, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    names, rows = spark_rows(QUERIES[name](spark, FOLDER))
    want_names, want = sql_rows(FOLDER, SQL[name])
    assert names == want_names
    assert rows == want, differences(rows, want)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
