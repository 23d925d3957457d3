from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from speclake.llm import warc


@pytest.mark.parametrize(
    ("url", "want"),
    [
        (None, None), (" ", None),
        ("HTTP://www.Example.com:80/a/?b=2&a=1#x", "example.com/a?a=1&b=2"),
        ("https://example.com/a?utm_source=x&ref=y", "example.com/a"),
        ("http://example.com:8080", "example.com:8080/"),
        ("http://e.com/%7Eu/%c3%a9", "e.com/~u/%C3%A9"),
        ("http://[bad", "http://[bad"),
    ],
)
def test_canonical(url, want):
    assert warc.canonical(url) == want


def record(rng, n, urls):
    kind = rng.choice(["response", "response", "revisit", "revisit", "request"])
    at = datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 40))
    tag = rng.choice(['"a"', '"b"', 'W/"a"', None])
    date = rng.choice(["Mon", "Tue", None])
    headers = {"content-type": "text/html", "x": str(n)} if kind == "response" else {"age": str(n)}
    headers |= {k: v for k, v in (("etag", tag), ("last-modified", date)) if v}
    body = str(rng.randint(0, 3)).encode() if kind == "response" else b""
    digest = rng.choice([None, warc.payload_digest(b"1"), warc.payload_digest(b"2")])
    return {
        "record_id": f"r{n:04}", "kind": kind, "url": rng.choice(urls), "at": rng.choice([at] * 9 + [None]),
        "refers_to": None, "profile": warc.PROFILE if kind == "revisit" else None,
        "digest": warc.payload_digest(body) if kind == "response" else digest,
        "status": rng.choice([200, 200, 404]) if kind == "response" else 304,
        "headers": headers, "body": body, "error": None,
    }


def brute(records):
    out = {}
    for r in records:
        if r["kind"] != "revisit":
            continue
        address = warc.canonical(r["url"])
        olds = [
            o for o in records
            if o["kind"] == "response" and o["status"] == 200 and address and r["at"] and o["at"]
            and warc.canonical(o["url"]) == address and o["at"] <= r["at"]
        ]
        old = max(olds, key=lambda o: (o["at"], o["record_id"]), default=None)
        if old is None:
            out[r["record_id"]] = (None, False, None)
            continue
        a, b = old["headers"].get("etag"), r["headers"].get("etag")
        c, d = old["headers"].get("last-modified"), r["headers"].get("last-modified")
        if a and b:
            weak = a.startswith("W/") or b.startswith("W/")
            holds = a.removeprefix("W/") == b.removeprefix("W/") if weak else a == b
        elif c and d:
            holds = c == d
        else:
            holds = not a and not b and r["digest"] is not None
        holds = holds and r["digest"] in (None, old["digest"])
        merged = old["headers"] | {k: v for k, v in r["headers"].items() if k in warc.PERMITTED}
        out[r["record_id"]] = (old["record_id"], holds, merged if holds else None)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(8)
    urls = ["http://a.com/x", "http://www.a.com/x?ref=1", "http://b.com/", None, ""]
    records = [record(rng, n, urls) for n in range(400)]
    files = spark.createDataFrame(
        [(b"".join(warc.written(r) for r in records[i : i + 7]),) for i in range(0, 400, 7)],
        "content BINARY",
    )
    found = warc.read(files)
    assert found.where("error IS NOT NULL").count() == 0 and found.count() == 400
    rows = warc.resolve(found).collect()
    assert {r.record_id: (r.source, r.resolved, r.headers) for r in rows} == brute(records)


def test_records_of_one_id(spark):
    """Revisits and responses that share ids, and rows that are there twice: every row by itself."""
    rng = random.Random(12)
    urls = ["http://a.com/x", "http://b.com/", None]
    records = [record(rng, n, urls) | {"record_id": f"r{n % 9}"} for n in range(150)]
    records = [r | {"headers": {"etag": '"a"', "n": str(i)}} for i, r in enumerate(records)]
    taken = set()
    for r in records:  # responses of one address, time and id would be ties
        while r["kind"] == "response" and r["at"] and (r["url"], r["at"], r["record_id"]) in taken:
            r["at"] += timedelta(seconds=100)
        taken.add((r["url"], r["at"], r["record_id"]))
    records += records[:30:7]
    files = spark.createDataFrame([(warc.written(r),) for r in records], "content BINARY")
    rows = warc.resolve(warc.read(files)).collect()
    want = [
        (r["record_id"], r["at"], *next(iter(brute([o for o in records if o["kind"] == "response"] + [r]).values())))
        for r in records
        if r["kind"] == "revisit"
    ]
    got = [(r.record_id, r.at, r.source, r.resolved, r.headers) for r in rows]
    want, got = ([(*x[:4], sorted((x[4] or {}).items())) for x in some] for some in (want, got))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 40


def test_malformed_records(spark):
    good = warc.written(record(random.Random(1), 1, ["http://a.com/"]))
    plain = __import__("gzip").decompress(good)
    rows = [(None,), (b"",), (b"no warc",), (good[:20],), (plain[:-30],), (plain + b"junk",)]
    found = warc.read(spark.createDataFrame(rows, "content BINARY"))
    assert found.where(F.col("error").isNotNull()).count() == 6 and found.count() == 7
    assert warc.resolve(found.limit(0)).collect() == []


def test_history_gives_every_page_three_revisits(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = warc.resolve(warc.read(warc.history(pages))).collect()
    assert len(rows) == 3 * pages.count()
    # Some pages share an address, and then the latest capture of it counts.
    again = [r for r in rows if r.record_id.endswith(":1")]
    assert sum(r.resolved for r in again) > 0.8 * len(again)
    assert {r.reason for r in again} <= {"resolved", "validators differ"}
    assert {r.reason for r in rows if r.record_id.endswith(":2")} == {"validators differ"}


def test_bodies_are_those_of_the_sources(spark):
    rng = random.Random(9)
    records = [record(rng, n, ["http://a.com/x", "http://b.com/"]) for n in range(200)]
    files = spark.createDataFrame([(warc.written(r),) for r in [*records, *records[:20]]], "content BINARY")
    found = warc.read(files)
    resolved = warc.resolve(found)
    rows = warc.with_bodies(resolved, found).collect()
    assert len(rows) == resolved.count() and any(r.resolved for r in rows)
    bodies = {r["record_id"]: r["body"] for r in records}
    for r in rows:
        got = None if r.body is None else bytes(r.body)
        assert got == (bodies[r.source] if r.resolved else None)


def test_history_of_pages_without_a_key(spark):
    pages = [(None, "http://a.com/1", "one"), (None, "http://a.com/2", "two"), (7, "http://a.com/3", "x")]
    frame = spark.createDataFrame(pages, "page_id LONG, url STRING, html STRING")
    found = warc.read(warc.history(frame))
    rows = warc.with_bodies(warc.resolve(found), found).collect()
    assert len(rows) == 9 and len({r.record_id for r in rows}) == 9
    again = {r.url: bytes(r.body) for r in rows if r.record_id.endswith(":1")}
    assert again == {u: t.encode() for _, u, t in pages}
