"""WARC archives of pages: writing with revisits and segments, reading with reassembly.

Writing.  Each page is a ``response`` with the html as the body of an HTTP response (chunked
transfer framing above ``CHUNK`` bytes), or, if its payload of at least ``MIN_REVISIT`` bytes
equals that of a page with a smaller page_id, a ``revisit`` of that page without payload.
A block above ``SEGMENT`` bytes is cut: the first record has WARC-Segment-Number 1, the rest
are ``continuation`` records with the origin's id, and the last of them has the total length.
Records are rows of a text writer whose separator is the blank line that ends a WARC record,
so archives go to whatever file system Spark writes to; files have a bounded record count.

Reading.  Whole records are decoded where they are read.  Pieces of segmented ones, wherever
they lie, are grouped by origin id and ordered by segment number; numbers must run from 1
without a gap and the joined block must have the stated total length; then the transfer
framing is undone and the payload compared with the stated digest.  Any mismatch raises.

Only digests and page ids are shuffled to find revisits; equal digests are combined before
the shuffle.  The repeated digests are broadcast while they are few (``common.BROADCAST``);
beyond that, pages meet them in a join that Spark can split.

Cases: null html is an empty payload; null url: no target header; null page_id: no page
header, counts as larger than any other; equal payloads of rows with the same smallest
page_id are all responses; control characters in a url are percent-encoded; an empty table
gives no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import table

from .common import limit_batches, need, scratch, small, written

SEGMENT = 16 << 10        # bytes of a record's block
CHUNK = 4 << 10           # bytes of a chunk of the transfer framing
MIN_REVISIT = 100
FILE_RECORDS = 2000       # records of a file: at most about 32 MB
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


# ----------------------------------------------------------------------------- framing

def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


def http_block(payload: bytes, with_body: bool) -> bytes:
    framed = with_body and len(payload) > CHUNK
    length = b"Transfer-Encoding: chunked" if framed else b"Content-Length: %d" % len(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + length + b"\r\n\r\n"
    return head + (chunked(payload) if framed else payload if with_body else b"")


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def page_records(page_id, row: int, url: str | None, html: bytes, digest: str, refers_to) -> Iterator[bytes]:
    """The records of one page, without the blank line after each."""
    kind = "response" if refers_to is None else "revisit"
    block = http_block(html, kind == "response")
    name = f"<urn:page:{'' if page_id is None else page_id}:{row}>"
    if url is not None:
        url = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    cut = len(block) > SEGMENT
    yield record([
        ("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("Page-ID", page_id),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Profile", PROFILE if refers_to is not None else None),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to['page_id']}:{refers_to['row']}>"),
        ("WARC-Segment-Number", 1 if cut else None)], block[:SEGMENT])
    for number, at in enumerate(range(SEGMENT, len(block), SEGMENT), 2):
        last = at + SEGMENT >= len(block)
        yield record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{number}>"), ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if last else None)], block[at:at + SEGMENT])


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        yield headers, content[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def decoded(headers: dict[str, str], block: bytes) -> tuple:
    """A RESULT row from an origin record's headers and its whole block."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    refers_to = headers.get("WARC-Refers-To")
    if refers_to is None:
        payload = unchunked(body) if lines.get("Transfer-Encoding") == "chunked" else body
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(lines.get("Content-Length", len(payload))):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest or length")
        size = len(payload)
    else:
        refers_to, size = int(refers_to.split(":")[2]), int(lines["Content-Length"])
    page_id = headers.get("Page-ID")
    return None if page_id is None else int(page_id), size, digest, headers["WARC-Type"], refers_to


# ------------------------------------------------------------------------------- Spark

def _columns(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    return _columns(rows, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                    [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            out = []
            for r in batch.slice(a, 256).to_pylist():
                out += page_records(r["page_id"], r["row"], r["url"], (r["html"] or "").encode(), r["digest"], r["refers_to"])
            yield _columns([(x,) for x in out], ["value"], [pa.binary()])


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            yield _result([decoded(h, b) for h, b in records(content.as_py()) if "WARC-Segment-Number" not in h])


def _read_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            yield _columns([(h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), int(h["WARC-Segment-Number"]),
                             h.get("WARC-Segment-Total-Length"), "\r\n".join(f"{k}: {v}" for k, v in h.items()), b)
                            for h, b in records(content.as_py()) if "WARC-Segment-Number" in h],
                           ["origin", "number", "total", "headers", "block"],
                           [pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary()])


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            pieces = r["pieces"]
            block = b"".join(p["block"] for p in pieces)
            if [p["number"] for p in pieces] != list(range(1, len(pieces) + 1)) or str(len(block)) != pieces[-1]["total"]:
                raise ValueError(f"segments of {r['origin']} are incomplete")
            rows.append(decoded(dict(x.split(": ", 1) for x in pieces[0]["headers"].split("\r\n")), block))
        yield _result(rows)


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages(page_id, url, html)`` as WARC files under ``path``."""
    limit_batches(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit(""))
    # The scan numbers its rows, by its splits and so each time alike; the numbers make records' names.
    rows = need(pages, page_id="bigint", url="string", html="string").withColumn(
        "row", F.monotonically_increasing_id()).withColumn("digest", F.sha2(html, 256))
    first = (rows.where(F.octet_length(html) >= MIN_REVISIT).groupBy("digest")
             .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1 AND first IS NOT NULL").drop("n"))
    rows = rows.join(small(written(first, "repeated")), "digest", "left").select(
        "page_id", "row", "url", "html", "digest",
        F.when(F.col("page_id").isNull() | (F.col("first.page_id") != F.col("page_id")), F.col("first")).alias("refers_to"))
    (rows.mapInArrow(_write, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A RESULT row for each response and revisit of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    pieces = files.mapInArrow(_read_pieces, "origin string, number int, total string, headers string, block binary")
    whole = pieces.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "headers", "block"))).alias("pieces"))
    return files.mapInArrow(_read_whole, RESULT).unionByName(whole.mapInArrow(_join_pieces, RESULT))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM q
"""
