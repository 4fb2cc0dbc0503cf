import hashlib

import pytest

from codeloom.llm import warc as A

SCHEMA = "page_id bigint, url string, html string, digest string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA)


def round_trip(spark, tmp_path, rows):
    path = str(tmp_path / "archive")
    A.write_archives(frame(spark, rows), path)
    return path, sorted(map(tuple, A.read_archives(spark, path).collect()), key=str)


def expected(rows):
    out = []
    for p, _, h in rows:
        h = (h or "").encode()
        same = [q for q, _, g in rows if (g or "").encode() == h and q is not None]
        first = min(same, default=None) if len(h) >= 100 else None
        revisit = first is not None and p != first
        out.append((p, len(h), hashlib.sha256(h).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_pages_of_all_sizes_and_copies(spark, tmp_path):
    body = "é\r\n\r\nWARC/1.1\r\n0\r\n\r\n"
    rows = [(i, f"http://h/{i}", body * (i * 40)) for i in range(40)]
    rows += [(100 + i, None, body * 3000) for i in range(5)] + [(200 + i, "http://x/ \r\n\x7fé", "short") for i in range(3)]
    rows += [(50, "u", None), (51, "u", ""), (None, "n", "z" * 200), (52, "u", "z" * 200), (53, "u", "z" * 200)]
    _, got = round_trip(spark, tmp_path, rows)
    assert got == expected(rows)


def test_whole_table(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    _, got = round_trip(spark, tmp_path, rows)
    assert got == expected(rows)


def test_every_revisit_refers_to_a_response(spark, tmp_path):
    rows = [(i, f"u{i}", "x" * (100 + i % 7)) for i in range(60)] + [(3, "u3", "x" * 103)] * 2 + [(None, "n", "x" * 101)]
    path, got = round_trip(spark, tmp_path, rows)
    heads = [h for f in spark.read.format("binaryFile").load(path).collect() for h, _ in A.records(bytes(f.content))]
    names = {h["WARC-Record-ID"]: h["WARC-Payload-Digest"] for h in heads if h["WARC-Type"] == "response"}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert got == expected(rows) and len(names) == sum(r[3] == "response" for r in got)
    assert len(revisits) == 54 and all(names[h["WARC-Refers-To"]] == h["WARC-Payload-Digest"] for h in revisits)


def test_repeated_rows_and_empty_table(spark, tmp_path):
    rows = [(1, "u", "a" * 300)] * 3 + [(2, "u", "a" * 300)]
    _, got = round_trip(spark, tmp_path, rows)
    assert got == expected(rows) and sum(r[3] == "response" for r in got) == 3
    A.write_archives(frame(spark, rows).limit(0), str(tmp_path / "none"))
    assert A.read_archives(spark, str(tmp_path / "none")).count() == 0


def pieces(html):
    return list(A.page_records(7, 0, "u", html, hashlib.sha256(html).hexdigest(), None))


def archive(spark, path, records):
    """Records one to a file, so no two pieces lie together."""
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(records)], "i int, v binary")
    df.repartition(len(records), "i").selectExpr("cast(v as string) v").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1).text(path)
    return path


def test_scattered_segments(spark, tmp_path):
    html = bytes(range(256)) * 400
    got = A.read_archives(spark, archive(spark, str(tmp_path / "x"), pieces(html)[::-1])).collect()
    assert [tuple(r) for r in got] == [(7, len(html), hashlib.sha256(html).hexdigest(), "response", None)]


@pytest.mark.parametrize("damage", ["lost", "last", "total", "content"])
def test_damaged_segments_raise(spark, tmp_path, damage):
    records = pieces(b"q" * 60_000)
    if damage == "lost":
        del records[1]
    elif damage == "last":
        del records[-1]
    elif damage == "total":
        records[-1] = records[-1].replace(b"Total-Length: 6", b"Total-Length: 7")
    else:
        records[1] = records[1].replace(b"qqqq", b"qqqr", 1)
    with pytest.raises(Exception, match="incomplete|differs|broken"):
        A.read_archives(spark, archive(spark, str(tmp_path / damage), records)).collect()


def test_framing():
    for n in (0, 1, 4096, 4097, 50_000):
        data = bytes(i % 251 for i in range(n))
        assert A.unchunked(A.chunked(data)) == data
    for headers, block in A.records(b"\r\n\r\n".join(pieces(b"a" * 40_000)) + b"\r\n\r\n"):
        assert len(block) == int(headers["Content-Length"]) <= A.SEGMENT
