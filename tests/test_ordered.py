"""Looking back along an order, with ranges much smaller than the keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from speclake.operators.ordered import with_value_before


@pytest.mark.parametrize("skip_nulls", [False, True])
def test_value_before(spark, skip_nulls):
    random.seed(7)
    # One key holds most rows; orders have gaps longer than a range.
    places = {"hot": random.sample(range(400), 150), "b": [5, 6, 90], "c": [3], "d": [399, 0]}
    rows = [
        (key, at, random.choice([None, None, f"{key}{at}"])) for key in places for at in places[key]
    ]
    frame = spark.createDataFrame(rows, "key STRING, at LONG, value STRING")
    got = with_value_before(
        frame, ["key"], "at", F.col("value"), "before", skip_nulls, width=8
    ).collect()
    want = {}
    for key in places:
        last = None
        for _, at, value in sorted(r for r in rows if r[0] == key):
            want[key, at] = last
            if value is not None or not skip_nulls:
                last = value
    assert {(r.key, r.at): r.before for r in got} == want and len(got) == len(rows)
