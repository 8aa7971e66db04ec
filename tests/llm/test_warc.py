"""WARC derivatives: links, digests, headers, and a round trip through files."""

import hashlib

from pyspark.sql import functions as F

from spindle.llm import registry, warc


def test_every_page_has_two_linked_records(spark, sf):
    rows = registry.op5_warc(spark, sf).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    by_id = {r.record_id: r for r in rows}
    for r in rows:
        other, page = by_id[r.concurrent_to], pages[r.page_id]
        assert other.concurrent_to == r.record_id and other.refers_to == r.refers_to and {r.record_type, other.record_type} == {"metadata", "conversion"}
        assert r.target_uri == page.url and r.source_digest == "sha256:" + hashlib.sha256(page.html.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.content_length == len(r.block.encode())
        assert r.source_headers.startswith("HTTP/1.1 200 OK\r\nContent-Type: text/html")


def test_text_and_metadata(spark):
    html = '<html><head><title> A &amp; B </title><style>x</style></head><body><!-- no --><h1>One</h1><p>two <b>three</b>&nbsp;&lt;four&gt;<script>var a="</p>";</script></p>\n <a class=x HREF="/u?a=1&amp;b=2">link</a></body></html>'
    rows = {r.record_type: r for r in warc.derivatives(warc.responses(spark.createDataFrame([(1, "http://a/", html)], "page_id long, url string, html string")), "page_id").collect()}
    assert rows["conversion"].block == "One\ntwo three <four>\nlink"
    assert rows["metadata"].block.startswith("title: A & B\r\nsource-content-type: text/html; charset=utf-8\r\n") and rows["metadata"].block.endswith("outlink: /u?a=1&b=2 A/@href\r\n")


def test_odd_rows_and_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, None, None), (None, "http://b/", ""), (2, "http://c/", "<p>é 漢 " + "x" * 100_000), (2, "http://c/", "plain\r\n\r\nWARC/1.1\r\n")], "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    records = warc.derivatives(warc.responses(pages), "page_id")
    assert records.count() == 8 and warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    warc.write(records.repartition(2), str(tmp_path / "out"))
    back = warc.read(spark, str(tmp_path / "out" / "*.gz"))
    names = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "block"]
    same = lambda frame: sorted(map(tuple, frame.withColumn("block", F.col("block").cast("string")).select(names).collect()))
    assert same(back) == same(records)
    bare = spark.createDataFrame([("<urn:x>", "u", "d", None), ("<urn:y>", "u", "d", "no headers")], "record_id string, target_uri string, warc_date string, block string")
    assert {r.refers_to: r.block for r in warc.derivatives(bare).where("record_type = 'conversion'").collect()} == {"<urn:x>": "", "<urn:y>": "no headers"}


def derived(block):
    return {r[0]: dict(zip(warc._COLUMNS, r)) for r in warc.derived("<urn:x>", "u", "d", block)}


def test_entities_headers_and_lone_signs():
    got = derived("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A: b\r\n\r\n<p>&copy; &middot; &#169;&#xA9; &nosuch; 1 < 2 &amp;lt;</p><a title='x' href='/?a=1&amp;b'>z</a>")
    assert got["conversion"]["block"] == "\u00a9 \u00b7 \u00a9\u00a9 &nosuch; 1 < 2 &lt;\nz"
    assert "source-header: X-A: b\r\n" in got["metadata"]["block"] and got["metadata"]["block"].endswith("outlink: /?a=1&b A/@href\r\n")


def test_time_follows_the_length_of_hostile_pages():
    import time

    for bad in ("<script>", "<!--", "<style ", "<title>", "<p ", "<a ", "<", "<a href='", "<a href=' ", "&", "</script ", "<head>", "&#1", "\n \n"):
        began = time.time()
        derived(bad * 200_000)
        assert time.time() - began < 5, bad


def test_what_is_not_utf8_or_null(spark, tmp_path):
    raw = b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe caf\xe9"
    rows = spark.createDataFrame([(None, None, None, bytearray(raw)), (None, "v", None, None), ("<urn:x>", "u", "d", bytearray(b""))], "record_id string, target_uri string, warc_date string, block binary")
    records = warc.derivatives(rows)
    assert records.where(F.col("refers_to").isNull()).select("record_id").distinct().count() == 4
    assert records.first().source_digest == "sha256:" + hashlib.sha256(b"\xff\xfe caf\xe9").hexdigest()
    warc.write(records, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w" / "*.gz")).collect()
    assert len(back) == 6 and sorted((r.record_id, bytes(r.block).decode()) for r in back) == sorted((r.record_id, r.block) for r in records.collect())
