"""Documents landed by a stream: batches that come again change nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from speclake.sources.sites import Sites
from speclake.streaming import landing

SITES = Sites({"generic": {"name": "Any", "specs": [{"type": "text", "selector": "b"}]}})


@pytest.fixture
def land(spark, tmp_path):
    place = f"file://{tmp_path}"

    def run(number, *rows):
        frame = spark.createDataFrame(list(rows), "url STRING, day STRING, html STRING")
        landing.land_batch(frame, number, place, F.to_timestamp("day"), sites=SITES)
        kept = landing.landed_documents(spark, place).collect()
        assert len({(r.run_date, r.address) for r in kept}) == len(kept)
        value = F.get_json_object("document", "$.kv.General.Text")
        shown = landing.landed_documents(spark, place).select("run_date", "address", value.alias("v"))
        dead = landing.dead_letters(spark, place).select("address", "error").collect()
        return sorted(map(tuple, shown.collect())), sorted(map(tuple, dead))

    return run


def test_replay_and_upsert(land):
    first = [("u1", "2026-01-01", "<b>1</b>"), ("u2", "2026-01-01", "<b>2</b>"), ("u3", "2026-01-01", None)]
    want = [("260101", "u1", "1"), ("260101", "u2", "2")]
    dead = [("u3", landing.NO_TEXT)]
    assert land(0, *first) == (want, dead)
    assert land(0, *first) == (want, dead)  # delivered again
    assert land(0, *first[::-1]) == (want, dead)
    # A page that comes again replaces its document of that day; one without text does not.
    second = [("u1", "2026-01-01", "<b>9</b>"), ("u2", "2026-01-02", "<b>2</b>"), ("u2", "2026-01-01", " ")]
    want = [("260101", "u1", "9"), ("260101", "u2", "2"), ("260102", "u2", "2")]
    dead = [("u2", landing.NO_TEXT), *dead]
    for _ in range(2):
        assert land(1, *second) == (want, dead)
    assert land(2, *first)[0] == [("260101", "u1", "1"), *want[1:]]


def test_addresses(land):
    """Pages of one canonical address are one page; the last of a batch counts."""
    link = '<link rel="canonical" href="https://c.test/x"><b>{}</b>'
    rows = [(f"u{i}", "2026-01-01", link.format(i)) for i in range(3)] + [(None, "2026-01-01", "<b>n</b>")]
    kept, dead = land(5, *rows)
    assert not dead and kept[0][:2] == ("260101", "260101_unknown_url.json") and kept[0][2] == "n"
    assert [k[1:] for k in kept[1:]] == [("https://c.test/x", "2")]


def test_empty_batch(land):
    assert land(0, ("u", "2026-01-01", "<b>1</b>"))[0] == [("260101", "u", "1")]
    assert land(1, ("u", "2026-01-01", None))[0] == [("260101", "u", "1")]
