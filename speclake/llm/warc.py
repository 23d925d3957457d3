"""WARC records and the resolution of not-modified revisits.

A revisit of profile ``server-not-modified`` holds no body: the page is that of
the latest full response of the same address captured before.  Addresses are
compared in canonical form.

The as-of join works on narrow rows in the order (address, time, record).  They
are dealt by ranges of that order, so one address with a third of all captures
is spread over many tasks; each range is written once and is then a part of
its own.  Within a part, the latest response before each row is the last one
seen; what crosses parts is, for an address that spans several, the latest
response of each part, one row per address and part.  Only then are headers
joined, by record, and by ``with_bodies`` the pages.

A revisit is resolved only if its validators agree with the response's: strong
entity tags must be equal, weak ones equal but for the mark, and without a tag
on both sides the modification dates; a stated payload digest must be the
response's.  The headers that a 304 may change are taken from the revisit, all
others from the response.

Defined cases: rows with a NULL or empty address or time are not joined and
come back unresolved; of responses of one time the greatest record id counts;
a response of the revisit's own time counts as earlier; equal rows are
resolved alike; an empty table gives no rows; malformed records give rows with
an ``error``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speclake.llm.shared import arrow_schema, staged

PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"

# Header fields that a 304 response may carry to update a stored one.
PERMITTED = (
    "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary",
    "age", "warning", "strict-transport-security",
)
TRACKING = re.compile(r"(utm_[a-z]+|gclid|fbclid|ref|phpsessid|jsessionid|sid)$")

RECORD = (
    "record_id STRING, kind STRING, url STRING, at TIMESTAMP, refers_to STRING, profile STRING, "
    "digest STRING, status INT, headers MAP<STRING, STRING>, body BINARY, error STRING, "
    "address STRING"
)
PART = 4 << 20  # bytes of records that are handed over at once


def canonical(url: str | None) -> str | None:
    """One form of an address: lower-case host without www, sorted query, no session or fragment."""
    if not url or not url.strip():
        return None
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip()
    host = re.sub(r"^www\d*\.", "", host)
    if port and (parts.scheme.lower(), port) not in (("http", 80), ("https", 443)):
        host = f"{host}:{port}"
    path = quote(unquote(parts.path), safe="/~!$&'()*+,;=:@-._") or "/"
    if len(path) > 1:
        path = path.rstrip("/")
    fields = sorted(
        f for f in parts.query.split("&") if f and not TRACKING.match(f.split("=")[0].lower())
    )
    return host + path + ("?" + "&".join(fields) if fields else "")


def written(record: dict) -> bytes:
    """One record in WARC 1.1 form, gzip-packed as one member."""
    lines = []
    if record["status"] is not None:
        lines.append(f"HTTP/1.1 {record['status']} {'OK' if record['status'] == 200 else 'Not Modified'}")
        lines += [f"{k}: {v}" for k, v in (record["headers"] or {}).items()]
    block = ("\r\n".join(lines) + "\r\n\r\n").encode() if lines else b""
    block += record["body"] or b""
    head = {
        "WARC-Type": record["kind"],
        "WARC-Record-ID": f"<{record['record_id']}>",
        "WARC-Target-URI": record["url"],
        "WARC-Date": record["at"].strftime("%Y-%m-%dT%H:%M:%S.%fZ") if record["at"] else None,
        "WARC-Refers-To": f"<{record['refers_to']}>" if record["refers_to"] else None,
        "WARC-Profile": record["profile"],
        "WARC-Payload-Digest": record["digest"],
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    fields = "\r\n".join(f"{k}: {v}" for k, v in head.items() if v is not None)
    return gzip.compress(b"WARC/1.1\r\n" + fields.encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _fields(block: bytes) -> dict[str, str]:
    """Header fields, names in lower case; lines that go on are joined, the last of a name counts."""
    out: dict[str, str] = {}
    name = None
    for line in block.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parsed(data: bytes | None) -> list[dict]:
    """All records of some bytes, gzip-packed or plain."""
    from datetime import UTC, datetime

    blank = dict.fromkeys(
        "record_id kind url at refers_to profile digest status headers body error".split()
    )
    if not data:
        return [blank | {"error": "no bytes"}]
    try:
        if data[:2] == b"\x1f\x8b":
            data = gzip.decompress(data)
    except (OSError, EOFError) as e:
        return [blank | {"error": f"gzip: {e}"}]
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            return [*out, blank | {"error": "no record head"}]
        head = _fields(data[at:end])
        row = dict(blank)
        try:
            size = int(head["content-length"])
            if len(data) < end + 4 + size:
                raise ValueError("record is cut off")
            block = data[end + 4 : end + 4 + size]
            row |= {
                "record_id": head["warc-record-id"].strip("<>"),
                "kind": head["warc-type"].lower(),
                "url": head.get("warc-target-uri", "").strip("<>") or None,
                "refers_to": (head.get("warc-refers-to") or "").strip("<>") or None,
                "profile": head.get("warc-profile"),
                "digest": head.get("warc-payload-digest"),
            }
            when = head.get("warc-date")
            row["at"] = datetime.fromisoformat(when).astimezone(UTC) if when else None
            if block.startswith(b"HTTP/"):
                lines, _, body = block.partition(b"\r\n\r\n")
                first, _, rest = lines.partition(b"\r\n")
                row |= {"status": int(first.split()[1]), "headers": _fields(rest), "body": body}
            else:
                row["body"] = block
            at = end + 4 + size
        except (KeyError, ValueError, IndexError) as e:
            return [*out, blank | {"error": f"{type(e).__name__}: {e}"}]
        out.append(row)
        while data.startswith(b"\r\n", at):
            at += 2
    return out


def read(files: DataFrame, content: str = "content") -> DataFrame:
    """Records of WARC bytes, one or more per row, with their canonical addresses."""
    shape = arrow_schema(RECORD)

    def batch_of(rows):
        for r in rows:
            r["headers"] = list((r["headers"] or {}).items())
            r["address"] = canonical(r["url"])
        return pa.record_batch([pa.array([r[f.name] for r in rows], f.type) for f in shape], schema=shape)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for data in batch.column(0):
                found = parsed(data.as_py())
                rows += found
                size += sum(len(r["body"] or b"") + 500 for r in found)
                if size >= PART:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return files.select(F.col(content).cast("binary")).mapInArrow(run, RECORD)


def payload_digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def _tag(headers: str) -> Column:
    return F.col(headers)["etag"]


def _agree() -> Column:
    """Whether the revisit's validators are those of the response."""
    weak = lambda tag: F.regexp_replace(tag, "^[Ww]/", "")
    old, new = F.col("o_tag"), F.col("tag")
    both_strong = ~old.startswith("W/") & ~new.startswith("W/")
    tags = F.when(both_strong, old == new).otherwise(weak(old) == weak(new))
    dates = F.col("o_modified") == F.col("modified")
    digest = F.col("digest").isNull() | (F.col("digest") == F.col("o_digest"))
    return F.coalesce(
        digest
        & F.when(old.isNotNull() & new.isNotNull(), tags)
        .when(F.col("o_modified").isNotNull() & F.col("modified").isNotNull(), dates)
        .otherwise(old.isNull() & new.isNull() & F.col("digest").isNotNull()),
        F.lit(False),
    )


def latest_before(captures: DataFrame) -> DataFrame:
    """(row, source_row): for every revisit the latest full response of its address before it.

    ``row`` tells a capture from all others, also from those of its record id.
    Of responses of one time the one of the greatest (record_id, row) counts.
    """
    order = ["address", "at", "late", "record_id", "row"]
    rows = captures.where("address IS NOT NULL AND at IS NOT NULL").select(
        "address", "at", "record_id", "row",
        (F.col("kind") == "revisit").alias("late"),
        F.when(F.col("kind") == "response", F.col("row")).alias("own"),
    )
    # Ranges of the order; written, so a part is the same rows in every later step.
    ranged = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    held = staged(ranged)
    within = Window.partitionBy("part", "address").orderBy("at", "late", "record_id", "row")
    seen = held.withColumn(
        "inner", F.last("own", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    )
    ends = held.groupBy("address", "part").agg(
        F.max_by("own", F.when(F.col("own").isNotNull(), F.struct("at", "record_id", "row"))).alias("end")
    )
    over = Window.partitionBy("address").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("carry", F.last("end", ignorenulls=True).over(over)).where(
        "carry IS NOT NULL"
    )
    return (
        seen.where("late")
        .join(carried.select("address", "part", "carry"), ["address", "part"], "left")
        .select("row", F.coalesce("inner", "carry").alias("source_row"))
        .where("source_row IS NOT NULL")
    )


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit, of records as ``read`` gives them, with what it stands for.

    Each record counts, also those that share a record id or are there twice.
    Columns: record_id, url, at, source (record id of the response, NULL if
    there is none), resolved, reason, status, headers (merged), digest, length.
    """
    captures = records.where(
        F.col("kind").isin("response", "revisit") & F.col("error").isNull()
    )
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    not_modified = (F.col("kind") == "revisit") & F.coalesce(
        F.col("profile").endswith("server-not-modified"), F.lit(False)
    )
    captures = staged(
        captures.where(full | not_modified).select(
            "record_id", "kind", "url", "address", "at", "digest", "headers",
            F.octet_length("body").cast("long").alias("length"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    found = latest_before(captures)
    olds = captures.where("kind = 'response'").select(
        F.col("row").alias("source_row"),
        F.col("record_id").alias("source"),
        F.col("digest").alias("o_digest"),
        F.col("headers").alias("o_headers"),
        F.col("length").alias("o_length"),
    )
    revisits = captures.where("kind = 'revisit'")
    # Revisits without a source take no part in the join by source.
    sourced = revisits.join(found, "row").join(olds, "source_row")
    rows = (
        revisits.join(found, "row", "left_anti")
        .unionByName(sourced, allowMissingColumns=True)
        .withColumns(
            {
                "tag": _tag("headers"), "o_tag": _tag("o_headers"),
                "modified": F.col("headers")["last-modified"],
                "o_modified": F.col("o_headers")["last-modified"],
            }
        )
        .withColumn("resolved", F.col("source").isNotNull() & _agree())
    )
    permitted = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("o_headers", lambda k, _: ~F.array_contains(F.map_keys(permitted), k))
    merged = F.map_concat(kept, permitted)
    return rows.select(
        "record_id",
        "url",
        "at",
        "source",
        "resolved",
        F.when(F.col("resolved"), "resolved")
        .when(F.col("address").isNull() | F.col("at").isNull(), "no address or time")
        .when(F.col("source").isNull(), "no earlier response")
        .otherwise("validators differ")
        .alias("reason"),
        F.when(F.col("resolved"), F.lit(200)).alias("status"),
        F.when(F.col("resolved"), merged).alias("headers"),
        F.when(F.col("resolved"), F.col("o_digest")).alias("digest"),
        F.when(F.col("resolved"), F.col("o_length")).alias("length"),
    )


def with_bodies(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """What ``resolve`` gave for these records, with the page: the body of the source.

    NULL where the revisit is not resolved.
    """
    bodies = (
        records.where((F.col("kind") == "response") & F.col("error").isNull())
        .where("status = 200")
        .select(
            F.col("record_id").alias("_source"),
            F.col("digest").alias("_digest"),
            F.octet_length("body").cast("long").alias("_length"),
            "body",
        )
        # Records of one id may differ: the body is of the digest that was given.
        .dropDuplicates(["_source", "_digest", "_length"])
    )
    same = (
        F.col("resolved")
        & (F.col("source") == F.col("_source"))
        & F.col("digest").eqNullSafe(F.col("_digest"))
        & F.col("length").eqNullSafe(F.col("_length"))
    )
    return resolved.join(bodies, same, "left").drop("_source", "_digest", "_length")


HISTORY = "content BINARY"


def history(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Captures of pages as WARC bytes, for pages that were not kept as such.

    Per page: a full response, then three later revisits: one with the same
    entity tag, one whose tag has changed, one with a weak tag and new headers
    under another spelling of the address.  Times follow from the key; pages
    without one are named by a hash of address and text.
    """
    from datetime import UTC, datetime, timedelta

    def run(batches):
        done, size = [], 0
        for batch in batches:
            for k, u, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (body or "").encode()
                name = k
                if k is None:
                    name = hashlib.sha1(repr(u).encode() + b"\n" + data).hexdigest()
                    k = int(name[:8], 16)
                start = datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=k % 5000, minutes=k % 50)
                tag = f'"{hashlib.sha1(data).hexdigest()[:16]}"'
                digest = payload_digest(data)
                base = {"refers_to": None, "profile": None, "digest": digest, "body": b"", "url": u}
                full = base | {
                    "record_id": f"urn:page:{name}:0", "kind": "response", "at": start, "status": 200,
                    "headers": {"Content-Type": "text/html", "ETag": tag, "Cache-Control": "max-age=60",
                                "Content-Length": str(len(data))},
                    "body": data,
                }
                again = {"kind": "revisit", "profile": PROFILE, "status": 304}
                spelled = u and u.replace("://", "://www.", 1) + ("&" if "?" in u else "?") + "utm_source=x"
                if u and "#" in u:
                    spelled = u.split("#")[0]
                revisits = [
                    base | again | {
                        "record_id": f"urn:page:{name}:1", "at": start + timedelta(days=1),
                        "headers": {"ETag": tag, "Content-Length": "0"},
                    },
                    base | again | {
                        "record_id": f"urn:page:{name}:2", "at": start + timedelta(days=2),
                        "headers": {"ETag": f'"{name}"'}, "digest": None,
                    },
                    base | again | {
                        "record_id": f"urn:page:{name}:3", "at": start + timedelta(days=3), "url": spelled,
                        "headers": {"ETag": "W/" + tag, "Cache-Control": f"max-age={k % 90}"},
                        "digest": None,
                    },
                ]
                done.append(b"".join(written(r) for r in (full, *revisits)))
                size += len(done[-1])
                if size >= PART:
                    yield pa.record_batch([pa.array(done, pa.binary())], names=["content"])
                    done, size = [], 0
        if done:
            yield pa.record_batch([pa.array(done, pa.binary())], names=["content"])

    return pages.select(F.col(key).cast("long"), F.col(url), F.col(html)).mapInArrow(run, HISTORY)


def digest(resolved: DataFrame) -> DataFrame:
    """Results with headers as text, in the order of their names."""
    pairs = F.transform(
        F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])
    )
    return resolved.withColumn("headers", F.array_join(pairs, ";"))
