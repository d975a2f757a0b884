import base64
import gzip
import hashlib

import duckdb
from pyspark.sql import types as T

from pulseloom.llm import warc

from . import edge

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("path", T.StringType()), T.StructField("digest", T.IntegerType())])

TRICKY = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\nhttp://x 1.2.3.4 20240101000000 text/html 5\n"

ROWS = [
    (5, "http://a.example/x y\n", "same"),
    (3, None, "same"),
    (9, "https://b.example/é", None),
    (4, "http://c.example/", ""),
    (None, "http://d.example/", "same"),
    (None, "http://e.example/", "only here, without an id"),
    (7, "http://f.example/", TRICKY),
    (8, "http://g.example/", TRICKY * 3000),
    (8, "http://g.example/", TRICKY * 3000),
    (10, "http://h.example/", "naïve 日本 🙂 \x1c"),
]


def brute(rows):
    low = {}
    for p, _, h in rows:
        h = (h or "").encode()
        if p is not None:
            low[h] = min(low.get(h, p), p)
    out = []
    for p, _, h in rows:
        h = (h or "").encode()
        first = low.get(h)
        again = first is not None and p != first
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def got(spark, pages, tmp, cfg=warc.ArchiveConfig()):
    pages.write.parquet(f"{tmp}/pages.parquet")
    return sorted((tuple(r) for r in warc.op5_arc_to_warc(spark, str(tmp), cfg).collect()), key=str)


def test_edges(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], PAGES)
    assert got(spark, pages, tmp_path / "one") == brute(ROWS)
    assert got(spark, pages, tmp_path / "many", warc.ArchiveConfig(file_bytes=1000)) == brute(ROWS)
    assert got(spark, pages.where("false"), tmp_path / "none") == []


def test_sf_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{edge.SF}/pages.parquet").select("page_id", "url", "html").collect()]
    out = sorted((tuple(r) for r in warc.op5_arc_to_warc(spark, edge.SF).collect()), key=str)
    assert out == brute(rows)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{edge.SF}/pages.parquet'")
    assert sorted(con.sql(warc.oracle()).fetchall(), key=str) == out


def test_both_versions_and_records():
    import gzip

    for version in (1, 2):
        text = warc.version_block(version, "f") + "\n" + "\n".join(warc.arc_record(version, "f", i, p, u, h or "") for i, (p, u, h) in enumerate(ROWS)) + "\n"
        records = list(warc.read_arc(gzip.compress(text.encode())))
        assert records[0].number == -1 and warc.warc_type(records[0].url) == "warcinfo"
        assert [warc.split_http(r.block)[2].decode() for r in records[1:]] == [h or "" for _, _, h in ROWS]
        assert records[1].url == "http://a.example/x%20y%0A" and len(records[1].date) == 14
        out = b"".join(warc.warc_record("f", r, None) + b"\r\n\r\n" for r in records)
        half = len(out) // 2
        back = list(warc.read_warc(gzip.compress(out[:half]) + gzip.compress(out[half:])))
        assert [b for _, b in back] == [r.block for r in records]
        assert back[1][0]["WARC-Date"] == "2024-01-01T00:00:05Z" and back[0][0]["WARC-Type"] == "warcinfo"
        assert len({f["WARC-Record-ID"] for f, _ in back}) == len(back)


def test_pages_of_any_url(spark, tmp_path):
    urls = ["ftp://x/a", "example.com/x", " ", "", None, "filedesc://f", "FILEDESC:x", "mailto:a@b", "\t:\n"]
    rows = [(2 * k + c, u if not c else "http://copy/", f"page {k}") for k, u in enumerate(urls) for c in (0, 1)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)
    assert got(spark, pages, tmp_path) == brute(rows)


def test_payloads_of_any_bytes_go_round(spark, tmp_path):
    """Latin-1 pages and binary payloads keep their bytes, lengths and digests."""
    payloads = [b"caf\xe9 na\xefve", bytes(range(256)) * 40, b"", b"\xff\xfe\r\n\r\nWARC/1.1\r\n", b"caf\xe9 na\xefve"]
    out = warc.version_block(1, "old.arc").encode()
    for k, body in enumerate(payloads):
        block = b"HTTP/1.0 200 OK\r\nContent-Length: %d\r\nX-Page-Id: %d\r\n\r\n" % (len(body), k + 1) + body
        out += b"\nhttp://x.example/\xe9%d 1.2.3.4 20010203040506 image/gif %d\n" % (k, len(block)) + block
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.arc.gz").write_bytes(gzip.compress(out + b"\n"))
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    rows = sorted(warc.read_archives(spark, f"{tmp_path}/warc").collect(), key=lambda r: r.page_id)
    assert [(r.payload_bytes, r.payload_digest) for r in rows] == [(len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for b in payloads]
    assert [r.refers_to for r in rows] == [None, None, None, None, 1] and rows[0].date == "2001-02-03T04:05:06Z"


def test_offsets_are_places_in_the_file(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], PAGES)
    warc.write_arc(spark, pages, f"{tmp_path}/arc", warc.ArchiveConfig(file_bytes=1000))
    seen = 0
    for r in warc.files_of(spark, f"{tmp_path}/arc").collect():
        raw = gzip.decompress(r.content)
        for line in raw.split(b"\n"):
            fields = line.split(b" ")
            if len(fields) == 10 and fields[0].startswith(b"http") and fields[4] == b"200":
                assert raw[int(fields[7]) :].startswith(line)
                seen += 1
    assert seen
