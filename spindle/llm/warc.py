"""WARC derivatives: linked metadata and plain-text conversion records of responses, and WARC files in and out.

A response is a row: record_id, target_uri, warc_date, block (the HTTP message as text or bytes: status line, headers, blank
line, body). Its two derivatives name it in WARC-Refers-To and each other in WARC-Concurrent-To, and keep its headers and the
digest of its body's bytes. Each row is worked out by itself: no shuffle, and time in proportion to its length.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
# What has no end goes on to the end of the page, so each pattern reads a page once whatever it holds.
#: Elements whose content is no text, then those that end a line, then any other tag; in this order.
_DROPPED = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)|<title\b.*?(?:</title\s*>|\Z)")
_BREAKS = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|blockquote|pre|body|head|html)\b[^>]*(?:>|\Z)")
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*(?:>|\Z)")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
_TITLE = re.compile(r"(?is)<title\b[^>]*(?:>|\Z)(.*?)(?:</title\s*>|\Z)")
_LINK = re.compile(r"""(?i)<a\b[^<>]*?\bhref\s*=\s*["']([^"'<>]*)["']""")
_TYPE = re.compile(r"(?im)^content-type:[ \t]*([^\r\n]*)")
_BLANKS, _SPACES, _LINES = re.compile("[ \t\r\n]+"), re.compile("[ \t]+"), re.compile(" ?\n[ \n]*")


def _decoded(text: str) -> str:
    """The text with its named and numeric entities decoded, those that end in a semicolon; a no-break space is a blank."""
    return (_ENTITY.sub(lambda m: html.unescape(m[0]), text) if "&" in text else text).replace("\xa0", " ")


def plain_text(page: str) -> str:
    """The text of a page: no scripts, styles, title, comments or tags; entities decoded; blank runs and lines closed up.

    A sign < that begins no tag is text. An element, comment or tag without an end goes on to the end of the page.
    """
    lines = _TAG.sub("", _BREAKS.sub("\n", _BLANKS.sub(" ", _DROPPED.sub(" ", page))))
    return _LINES.sub("\n", _SPACES.sub(" ", _decoded(lines))).strip(" \n")


def _urn(*parts: str) -> str:
    """A urn:uuid (version 3 in form) of the MD5 of the parts: the same parts have the same id on every run."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(chr(10).join(parts).encode('utf-8', 'replace')).digest(), version=3)}>"


def record_id(*parts: Column) -> Column:
    """The same as an expression."""
    h = F.md5(F.concat_ws("\n", *parts))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def responses(pages: DataFrame, warc_date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response rows; a null url or html counts as empty."""
    url, html = F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF))
    return pages.select(F.col("page_id"), record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, F.md5(html)).alias("record_id"), url.alias("target_uri"), F.lit(warc_date).alias("warc_date"), F.concat(head, html).alias("block"))


_COLUMNS = ("record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "source_type", "source_headers", "source_digest", "block")


def derived(record: str | None, uri: str | None, date: str | None, block: str | bytes | None) -> Iterator[tuple]:
    """The metadata and the conversion record of one response, as _COLUMNS say."""
    data = block.encode("utf-8", "replace") if isinstance(block, str) else block or b""
    head, cut, body = data.partition(b"\r\n\r\n")
    headers, payload = (head.decode("utf-8", "replace"), body) if cut else ("", data)
    page, own = payload.decode("utf-8", "replace"), _digest(payload)
    kind = m[1] if (m := _TYPE.search(headers)) else ""
    title = _BLANKS.sub(" ", _decoded(m[1])).strip(" ") if (m := _TITLE.search(page)) else ""
    about = [f"title: {title}", f"source-content-type: {kind}", f"source-payload-digest: {own}", *(f"source-header: {line}" for line in headers.split(CRLF) if headers), *(f"outlink: {_decoded(x)} A/@href" for x in _LINK.findall(page))]
    names = (record,) if record is not None else ("", uri or "", date or "", hashlib.md5(data).hexdigest())
    ids = [_urn(k, *names) for k in ("metadata", "conversion")]
    for k, (which, what, text) in enumerate((("metadata", "application/warc-fields", "".join(x + CRLF for x in about)), ("conversion", "text/plain; charset=utf-8", plain_text(page)))):
        raw = text.encode("utf-8", "replace")
        yield which, ids[k], record, ids[1 - k], uri, date, what, len(raw), _digest(raw), kind, headers, own, raw.decode()


def derivatives(frame: DataFrame, *keep: str) -> DataFrame:
    """Two rows for each response row: its metadata and its conversion record.

    Columns: those in keep, then record_type, record_id, refers_to, concurrent_to, target_uri, warc_date, content_type,
    content_length (bytes), block_digest, source_type, source_headers, source_digest (of the body's bytes) and block. The metadata
    block has the title, the source's type, digest and header lines, and the links. A null block counts as empty, as does a body
    that is not there: its records have an empty text, title and list of links. Bytes that are no UTF-8 are replaced in texts,
    not in source_digest. A null record_id stays null in refers_to; the ids of such records come from the rest of the row. Repeated
    rows give repeated records; an empty table gives none.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [r for given in zip(*(part.column(i).to_pylist() for i in range(len(keep), len(keep) + 4))) for r in derived(*given)]
                twice = pa.array([i // 2 for i in range(2 * part.num_rows)], pa.int32())
                made = [pa.array(c, pa.int64() if n == "content_length" else pa.string()) for n, c in zip(_COLUMNS, zip(*rows))]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(twice) for i in range(len(keep))), *made], [*keep, *_COLUMNS])

    block = F.col("block") if frame.schema["block"].dataType.typeName() == "binary" else F.col("block").cast("string").alias("block")
    read = frame.select(*keep, *(F.col(c).cast("string").alias(c) for c in ("record_id", "target_uri", "warc_date")), block)
    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[: len(keep)]]
    return read.mapInArrow(each, ", ".join([*shape, *(f"{c} {'long' if c == 'content_length' else 'string'}" for c in _COLUMNS)]))


def as_text(records: DataFrame) -> Column:
    """One derivative record as it stands in a WARC file, without the last line feed; a header that is null is left out."""
    lines = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type")]
    block = F.coalesce(records["block"], F.lit(""))
    head = [F.coalesce(F.concat(F.lit(f"{name}: "), records[c].cast("string"), F.lit(CRLF)), F.lit("")) for name, c in lines]
    return F.concat(F.lit("WARC/1.1" + CRLF), *head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block, F.lit("\r\n\r"))


def write(records: DataFrame, path: str) -> None:
    """Writes derivative records as gzipped WARC files, one for each partition (a member of gzip is a file, not a record)."""
    records.select(as_text(records).alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record of a WARC file, gzipped or not."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length") or 0))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: record_type, record_id, refers_to, target_uri, warc_date, content_type, block (bytes as they are).
    A file is read by one task, which gives its records in lots; files are cut at about a gigabyte by those who write them."""
    names = {"record_type": "warc-type", "record_id": "warc-record-id", "refers_to": "warc-refers-to", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type"}
    kinds = [*[pa.string()] * len(names), pa.binary()]

    def lot(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*names, "block"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for headers, block in parsed(data.as_py()):
                    rows.append((*map(headers.get, names.values()), block))
                    if len(rows) == 256:
                        yield lot(rows)
                        rows = []
                if rows:
                    yield lot(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(each, ", ".join(f"{c} string" for c in names) + ", block binary")
