"""Readers, site files, sinks, fragments and the stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from speclake.plans import extraction, fragments
from speclake.session import configure, require_settings, staged
from speclake.sources import readers, sinks
from speclake.sources.default_sites import SITES
from speclake.sources.sites import Sites, load_sites
from speclake.streaming.pages import page_stream, stream_documents


def test_url_list(spark, tmp_path):
    path = tmp_path / "in" / "urls.txt"
    assert readers.read_urls(spark, str(path)).collect() == []
    assert path.read_text().startswith("#")
    path.unlink()
    (path.parent / ".urls.txt.crc").unlink()
    path.write_text("\n http://a \n# no\n\t#no\nhttp://b#x\r\n")
    rows = readers.read_urls(spark, str(path)).orderBy("ord").collect()
    assert [r.url for r in rows] == ["http://a", "http://b#x"]


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>\u00e9</h1>\n<p>", encoding="utf-8")
    (tmp_path / "b.html").write_text("<h1>b</h1>")
    rows = readers.read_html_files(spark, str(tmp_path)).orderBy("path").collect()
    assert [r.html for r in rows] == ["<h1>\u00e9</h1>\n<p>", "<h1>b</h1>"]
    assert rows[0].path.endswith("/a.html")


def test_site_files(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(SITES, sort_keys=False), encoding="utf-8")
    (tmp_path / "s.json").write_text(json.dumps(SITES))
    built_in = load_sites()
    for name in ("s.yaml", "s.json"):
        sites = load_sites(tmp_path / name)
        assert sites.all() == built_in.all()
        assert sites.rules_in_order() == built_in.rules_in_order()
    assert [s.vendor for s in built_in.all()] == [
        "siemens", "abb", "schneider", "nexans", "vega", "phoenix", "generic"
    ]
    assert built_in.spec_source("no such site").vendor == "generic"
    with pytest.raises(FileNotFoundError):
        load_sites(tmp_path / "none.yaml")
    assert built_in.vendors(spark).count() == 7
    assert built_in.detect_rules(spark).count() == 16
    assert built_in.specs(spark).count() == 27


def test_priorities():
    sites = Sites({"late": {"detect": [{"id": "a"}]}, "x": {"priority": 200, "detect": [{"id": "b"}]},
                   "generic": {"detect": [{"always": True}]}})
    assert [s.vendor for s in sites.all()] == ["late", "generic", "x"]
    assert [vendor for vendor, _ in sites.rules_in_order()] == ["x", "late"]


def test_document_files(spark, tmp_path):
    page = (
        '<link rel=canonical href="http://www.phoenixcontact.com/a"><meta name=description '
        'content="\u00e9 [1]"><article class=se-result-pos><a class=se-result-pos-item-title '
        "href=/p><span>t</span></a></article>"
    )
    frame = spark.createDataFrame([(1, page)], "page_id INT, html STRING")
    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    documents = extraction.extract_documents(frame, extracted_at=at)
    out = str(tmp_path / "out")
    sinks.write_documents(documents, out)
    row = spark.read.json(out).first()
    assert (row.run_date, row.file_name) == (260102, "260102_phoenixcontact_com_a.json")
    assert json.loads(row.document) == {
        "vendor": "Phoenix Contact",
        "kv": {
            "Product Info": {"Description": "\u00e9 [1]"},
            "Product Variants": {
                "Items": [{"title": "t", "url": "https://www.phoenixcontact.com/p"}]
            },
        },
        "stats": {"meta_description": 1, "product_variants": 1},
        "metadata": {
            "canonical_url": "http://www.phoenixcontact.com/a",
            "extraction_timestamp": "02/01/2026 03:04:05",
        },
    }
    assert "\u00e9" in row.document


def test_page_files(spark, tmp_path):
    frame = spark.createDataFrame(
        [(1, "http://a/x", "1"), (2, "http://a/x?y", "2"), (3, "http://b", "3")],
        "page_id INT, url STRING, html STRING",
    )
    sinks.write_pages(frame, str(tmp_path / "p"))
    landed = sinks.latest(spark.read.parquet(str(tmp_path / "p")), ["file_name"], ["page_id"])
    assert sorted((r.file_name, r.page_id) for r in landed.collect()) == [
        ("a_x.html", 2), ("b.html", 3)
    ]


def test_crawl_record(spark):
    from speclake.operators.page import page_of

    page = (
        "<title> A\n B</title><meta name=keywords content=k><meta property='og:title' content=o>"
        "<meta property='og:description'>"
    )
    frame = spark.createDataFrame([(page, "u")], "html STRING, url STRING")
    parsed = extraction.read_trees(frame.withColumn("text", F.col("html")))
    row = sinks.crawl_records(
        parsed, page_of(), F.col("url"), F.lit("2026-01-02 03:04:05.5").cast("timestamp"),
        html=F.col("text"),
    ).first()
    assert row.scraped_at == "2026-01-02T03:04:05.500000" and row.success
    assert row.html_length == len(page)
    assert row.metadata.asDict() == {
        "title": "A B", "url": "u", "final_url": "u", "description": None, "keywords": "k",
        "og_title": "o", "og_description": None,
    }


def test_fragments_equal_the_merged_page(spark):
    """Fragments extracted one by one give what their merged page gives."""
    parts = [
        "<link rel=canonical href='http://x.test/1'><h2>A</h2><table><tr><td>k</td><td>1</td></tr>",
        "<dl><dt>d</dt><dd>1</dd></dl>",
        "<meta name=description content=first><p>Size: 1</p><h3>B</h3><p>Size: 2</p>",
        "<meta name=description content=second><dl><dt>d</dt><dd>2</dd></dl><h2>A</h2>",
        "<dl><dt>d</dt><dd>3</dd></dl><link rel=canonical href=no>",
    ]
    sites = Sites({"generic": {"specs": [
        {"type": "dl"}, {"type": "table"}, {"type": "label_value"}, {"type": "meta_description"},
    ]}})
    frame = spark.createDataFrame(
        [(1, i, p) for i, p in enumerate(parts)], "page INT, frag_no INT, html STRING"
    )
    pieces = fragments.extract_fragments(frame, F.lit("generic"), ["page"], sites)
    got = {
        (r.section, r.key, r.value) for r in fragments.fragment_kv(pieces, ["page"]).collect()
    }
    merged = spark.createDataFrame([(1, "".join(parts))], "page INT, html STRING")
    # The first table is left open on purpose: fragments are parsed on their own.
    kv = extraction.extract_documents(
        merged, sites, vendor=F.lit("generic")
    ).first().kv
    want = {(s, k, v) for s, entries in kv.items() for k, v in entries.items()}
    assert got == want
    canonical = fragments.fragment_canonical(pieces, ["page"]).first()
    assert canonical.canonical_url == "http://x.test/1"
    pieces.unpersist()


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = tmp_path / "in"
    pages.repartition(3).write.parquet(str(source))
    sites = Sites({"generic": {"specs": [{"type": "text", "selector": "div.ad"}]}})
    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    for _ in range(2):  # the second run finds nothing new
        stream_documents(
            page_stream(spark, str(source), files_per_batch=1), str(tmp_path / "out"),
            str(tmp_path / "checkpoint"), sites, extracted_at=at,
        ).awaitTermination()
    columns = ["page_id", "vendor", "kv", "stats", "metadata"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns).orderBy("page_id").collect()
    want = extraction.extract_documents(
        pages, sites, extracted_at=at
    ).select(columns).orderBy("page_id").collect()
    assert got == want and len(got) == 50


def test_bad_page_is_set_aside(spark, monkeypatch):
    import speclake.operators.parse as parse

    def fails(page, positions=False):
        raise ValueError("no")

    monkeypatch.setattr(parse, "read_tree", fails)
    frame = spark.createDataFrame([(1, "x")], "page_id INT, html STRING")
    extracted = extraction.extract_pages(frame, Sites({"generic": {"specs": [{"type": "dl"}]}}))
    row = extraction.quarantine(extracted).first()
    assert row.error == "ValueError: no" and row.hits == []


def test_session_helpers(spark, monkeypatch):
    many = spark.range(0, 100, 1, 20)
    kept = staged(many)
    assert kept.count() == 100 and kept.rdd.getNumPartitions() == 20
    # Kept rows are not worked out again, and lie in the shared folder.
    assert "Scan ExistingRDD" in kept._jdf.queryExecution().executedPlan().toString()
    require_settings(spark)
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        with pytest.raises(RuntimeError, match="mapKeyDedupPolicy"):
            require_settings(spark)
    finally:
        configure(spark)


def test_one_pass_without_shuffle(spark):
    """Scan to documents of all sites is one stage: no exchange, one parse."""
    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").drop("url")
    documents = extraction.extract_documents(frame)
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan


def test_counts_cover_keys_and_partitions_do_not_matter(spark):
    from catalogue.rendered import mixed_pages

    pages = mixed_pages(spark, "/root/testdata/sf0.001")
    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    found = []
    for n in (1, 8):
        documents = documents_of(pages.repartition(n, "p_partkey"), at)
        found.append({r.p_partkey: (r.vendor, r.kv, r.stats) for r in documents})
    assert found[0] == found[1] and len(found[0]) == 200
    for _, kv, stats in found[0].values():
        assert sum(stats.values()) >= sum(map(len, kv.values()))


def documents_of(pages, at):
    return extraction.extract_documents(pages, extracted_at=at).collect()


def test_large_page_stays_near_linear(spark):
    """A merged listing of 8,000 sections and 32,000 writes on one page."""
    import time

    piece = (
        "<h3>H{0}</h3><table><tr><td>a</td><td>{0}</td></tr></table><p>Size: {0}</p>"
        "<ul><li><b>x</b>y</li></ul><dl><dt>q</dt><dd>r</dd></dl>"
    )
    page = "<body>" + "".join(piece.format(i) for i in range(8000))
    frame = spark.createDataFrame([(1, page)], "page_id INT, html STRING")
    start = time.perf_counter()
    row = extraction.extract_documents(frame, vendor=F.lit("generic")).select(
        F.size("kv").alias("sections"), "stats", F.element_at("kv", "H7999").alias("last")
    ).first()
    assert row.sections == 8000 and row.stats == {
        "dl": 8000, "table": 8000, "label_value": 8000, "li_split": 8000
    }
    assert row.last == {"a": "7999", "Size": "7999", "x": "y", "q": "r"}
    assert time.perf_counter() - start < 60


def test_stream_reads_tables_of_several_files(spark, tmp_path):
    from catalogue.listings import stream_extract

    rows = [(i, f"u{i}", f'<html lang="l{i}"><div class="ad">a{i}</div></html>') for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    want = [(i, "Any", f"l{i}", f"a{i}") for i in range(6)]
    pages.repartition(3).write.parquet(f"{tmp_path}/many/pages.parquet")
    pages.coalesce(1).write.parquet(f"{tmp_path}/part")
    (one,) = (tmp_path / "part").glob("*.parquet")
    (tmp_path / "one").mkdir()
    one.rename(tmp_path / "one" / "pages.parquet")
    pages.limit(0).coalesce(1).write.parquet(f"{tmp_path}/none/pages.parquet")
    for folder, found in (("many", want), ("one", want), ("none", [])):
        rows = stream_extract(configure(spark), f"{tmp_path}/{folder}").collect()
        assert sorted(map(tuple, rows)) == found


def test_rendering_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    from catalogue import base

    monkeypatch.setattr(base, "RENDERED", 100)
    cores = spark.sparkContext.defaultParallelism
    assert base.rendering(spark.range(5)).rdd.getNumPartitions() == cores
    many = base.rendering(spark.range(100 * cores + 450))
    sizes = many.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == cores + 5 and max(r["count"] for r in sizes) <= 110
