"""Legacy archives (ARC 1 and 2) to WARC, and back to rows.

ARC files are read as binary files of bounded size and parsed by their version
block, the header line of that version and the declared lengths. The converter
synthesises WARC records from them: identifiers from the record's place,
timestamps from the 14-digit dates, types from place and block (whatever the
URL), digests from payload and block. A first pass over the archives yields digests alone; equal
payloads are grouped by them, the one with the smallest page_id is the response
and the others become revisits that refer to it. What refers where returns to
each file by its path, so that no payload is shuffled and no hot payload gathers
in one task.

Files are written by Spark's text writer (the record separator is the line
separator), so any store that Spark can write to works. It hands on the bytes of
a text as they are, so payloads of any encoding, and binary ones, stay whole.

Cases: null html is an empty payload, which is deduplicated like any other; a
null url becomes `unknown:`, white space in urls is percent-encoded; a null
page_id is carried as such and never the smallest; repeated rows of one page_id
with the smallest id are all responses; payloads may hold separators or header
lines, as only declared lengths count; a longer payload than a file's usual size
has a file of its own size; no pages give an empty archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, shared_dir, strings, table

#: Fields of a header line, by the version that a file's version block declares.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


@dataclass(frozen=True)
class ArchiveConfig:
    file_bytes: int = 8 << 20  # payload of one archive file
    min_payload: int = 0  # smaller payloads are always responses


def archive_url(url: str | None) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127)))) if url else "unknown:"


def http_block(page_id: int | None, payload: str) -> str:
    known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload.encode())}\r\n{known}\r\n{payload}"


def version_block(version: int, name: str) -> str:
    body = f"{version} 0 pulseloom\n{FIELDS[version]}\n"
    fixed = f"filedesc://{name} 0.0.0.0 20240101000000 text/plain"
    return f"{fixed} {len(body)}\n{body}" if version == 1 else f"{fixed} 200 - - 0 {name} {len(body)}\n{body}"


def arc_record(version: int, name: str, offset: int, page_id: int | None, url: str | None, html: str) -> str:
    block = http_block(page_id, html)
    size, second = len(block.encode()), abs(page_id or 0) % 86_400
    date = f"20240101{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}"
    if version == 1:
        return f"{archive_url(url)} 0.0.0.0 {date} text/html {size}\n{block}"
    return f"{archive_url(url)} 0.0.0.0 {date} text/html 200 - - {offset} {name} {size}\n{block}"


def write_arc(spark: SparkSession, pages: DataFrame, path: str, cfg: ArchiveConfig) -> None:
    """Legacy archives of the pages, files of both versions by turns."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    total = rows.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    files = max(1, -(-total // cfg.file_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, offset = TaskContext.get().partitionId(), 0  # offset: bytes of the file so far
        version, name = 1 + number % 2, f"part-{number:05d}.arc"
        head = True
        for batch in batches:
            out = [version_block(version, name)] if head else []
            offset += sum(len(x.encode()) + 1 for x in out)
            head = False
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strings(batch.column(2)).to_pylist(), strict=True):
                out.append(arc_record(version, name, offset, page_id, url, html))
                offset += len(out[-1].encode()) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    # By the place of a row, so that rows that agree in everything don't gather in one file.
    dealt = rows.withColumn("at", F.monotonically_increasing_id()).repartition(files, F.xxhash64("at")).drop("at")
    dealt.mapInArrow(run, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(path)


class Reader:
    """Bytes of a gzip file (one or several members), inflated as they are asked for."""

    def __init__(self, raw):
        self.raw, self.at, self.have, self.pos = memoryview(raw), 0, bytearray(), 0
        self.gz = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.gz.eof:
                rest = self.gz.unused_data
                self.at -= len(rest)
                if self.at >= len(self.raw):
                    return False
                self.gz = zlib.decompressobj(31)
            if self.at >= len(self.raw):
                return False
            piece = self.raw[self.at : self.at + (1 << 16)]
            self.at += len(piece)
            new = self.gz.decompress(piece)
            if new:
                del self.have[: self.pos]
                self.pos = 0
                self.have += new
                return True

    def line(self) -> bytes | None:
        """The next line with its end, or None at the end of the file."""
        seen = 0
        while (end := self.have.find(b"\n", self.pos + seen)) < 0:
            seen = len(self.have) - self.pos
            if not self._more():
                out = bytes(self.have[self.pos :])
                self.pos = len(self.have)
                return out or None
        out = bytes(self.have[self.pos : end + 1])
        self.pos = end + 1
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) - self.pos < n and self._more():
            pass
        if len(self.have) - self.pos < n:
            raise ValueError("the archive ends within a record")
        out = bytes(self.have[self.pos : self.pos + n])
        self.pos += n
        return out


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    number: int


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records of an archive by its version's header lines and the declared lengths; the version block itself comes first, as number -1."""
    source, version, number = Reader(raw), 0, -1
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        fields = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        block = source.take(int(fields[-1]))
        if number < 0:
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown archive version {version}")
        elif len(fields) != len(FIELDS[version].split(" ")):
            raise ValueError(f"a header line of version {version} has {len(fields)} fields")
        yield ArcRecord(fields[0], fields[1], fields[2], fields[3], block, number)
        number += 1


def split_http(block: bytes) -> tuple[dict[bytes, bytes], bytes, bytes]:
    """Header fields, the header itself and the payload of an HTTP response."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    fields = dict(re.findall(rb"^([A-Za-z-]+): *([^\r\n]*)", head, re.M))
    return fields, head + mark, payload


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str, number: int) -> str:
    """A version-8 UUID of a record's place."""
    h = bytearray(hashlib.sha1(f"{name}#{number}".encode()).digest()[:16])
    h[6], h[8] = 0x80 | h[6] & 0x0F, 0x80 | h[8] & 0x3F
    x = h.hex()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def warc_type(url: str, number: int = -1, block: bytes = b"") -> str:
    """Only the version block, number -1, is warcinfo; a page's URL does not decide anything."""
    return "warcinfo" if number < 0 else "response" if block.startswith(b"HTTP/") else "resource"


def warc_record(name: str, r: ArcRecord, refers: tuple[str, int, int] | None) -> bytes:
    """The WARC equivalent, without the final separator. refers: file, number and page_id of the response with the same payload."""
    d = r.date.ljust(14, "0")
    kind = "revisit" if refers else warc_type(r.url, r.number, r.block)
    block, payload_digest = r.block, None
    if kind in ("response", "revisit"):
        _, head, payload = split_http(r.block)
        payload_digest = base32_sha1(payload)
        block = head if refers else r.block
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(name, r.number)}", f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"]
    if kind != "warcinfo":
        lines += [f"WARC-Target-URI: {r.url}", f"WARC-IP-Address: {r.ip}"]
    if payload_digest:
        lines += [f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if refers:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers[0], refers[1])}", f"X-Refers-To-Page-Id: {refers[2]}"]
    mime = {"warcinfo": "text/plain", "resource": r.mime}.get(kind, "application/http; msgtype=response")
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {mime}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by the declared lengths."""
    source = Reader(raw)
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("no WARC record where one should begin")
        fields: dict[str, str] = {}
        while (line := source.line()) is not None and line.strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name] = value.strip()
        yield fields, source.take(int(fields["Content-Length"]))


def raw_text(records: list[bytes]) -> pa.RecordBatch:
    """Bytes as a text column, unchecked: the text writer hands them on as they are, whatever their encoding."""
    return pa.RecordBatch.from_arrays([pa.array(records, pa.binary()).view(pa.string())], names=["value"])


def shown(field: str) -> str:
    """A header field as text, whatever its bytes were."""
    return field.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def files_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def arc_digests(files: DataFrame) -> DataFrame:
    """(path, number, page_id, digest, bytes) of each record with a payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, out = batch.column(0)[k].as_py(), []
                for r in read_arc(batch.column(1)[k].as_buffer()):
                    if r.number >= 0 and r.block.startswith(b"HTTP/"):
                        fields, _, payload = split_http(r.block)
                        page = fields.get(b"X-Page-Id")
                        out.append((path, r.number, None if page is None else int(page), hashlib.sha1(payload).digest(), len(payload)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 5, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["path", "number", "page_id", "digest", "bytes"])

    return files.mapInArrow(run, "path string, number int, page_id long, digest binary, bytes long")


def short_name(path: str) -> str:
    return path.rpartition("/")[2]


def convert(spark: SparkSession, arc: str, warc: str, cfg: ArchiveConfig = ArchiveConfig()) -> None:
    """ARC files under `arc` as WARC files under `warc`."""
    base = scratch(spark, "arc-digests")
    arc_digests(files_of(spark, arc)).write.parquet(base)
    seen = spark.read.parquet(base).where(F.col("bytes") >= cfg.min_payload)
    first = seen.where("page_id is not null").groupBy("digest").agg(F.min(F.struct("page_id", "path", "number")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.select(F.col("digest").alias("d"), "first")
    again = seen.join(first, F.col("digest") == F.col("d")).where("page_id is null or page_id <> first.page_id")
    refs = again.groupBy(F.col("path").alias("of")).agg(F.collect_list(F.struct("number", F.col("first.path").alias("path"), F.col("first.number").alias("at"), F.col("first.page_id").alias("page_id"))).alias("refs"))
    files = files_of(spark, arc)
    # Revisits grow with the pages, so they aren't broadcast at any size; archives needn't be sorted to meet them.
    held = files.join(refs.hint("shuffle_hash"), F.col("path") == F.col("of"), "left").select("path", "content", "refs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = short_name(batch.column(0)[k].as_py())
                refers = {x["number"]: (short_name(x["path"]), x["at"], x["page_id"]) for x in batch.column(2)[k].as_py() or []}
                out, size = [], 0
                for r in read_arc(batch.column(1)[k].as_buffer()):
                    out.append(warc_record(name, r, refers.get(r.number)))
                    size += len(r.block)
                    if size > 1 << 21:
                        yield raw_text(out)
                        out, size = [], 0
                yield raw_text(out)

    held.mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response or revisit of WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri, date."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "date"]
        for batch in batches:
            for k in range(batch.num_rows):
                out = []
                for fields, block in read_warc(batch.column(1)[k].as_buffer()):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, _, payload = split_http(block)
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest != base32_sha1(payload):
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
                    page, to = http.get(b"X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                    size = len(payload) if kind == "response" else int(http[b"Content-Length"])
                    out.append((None if page is None else int(page), size, digest, kind, None if to is None else int(to), fields["WARC-Record-ID"], shown(fields["WARC-Target-URI"]), fields["WARC-Date"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 8, kinds, strict=True)], names=names)

    return files_of(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string")


def op5_arc_to_warc(spark: SparkSession, sf_dir: str, cfg: ArchiveConfig = ArchiveConfig()) -> DataFrame:
    shared_dir(spark)
    base = scratch(spark, "archives")
    write_arc(spark, table(spark, sf_dir, "pages"), f"{base}/arc", cfg)
    convert(spark, f"{base}/arc", f"{base}/warc", cfg)
    return read_archives(spark, f"{base}/warc").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (
    select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
        array_to_string(list_transform(range(32), lambda i: substr('{alphabet}', cast((
            (list_aggregate(list_transform(range(2), lambda b: (instr('0123456789abcdef', substr(sha1(html) || '0', cast(i * 5 // 4 + b + 1 as int), 1)) - 1) * (16 ** (1 - b))), 'sum')::bigint
            >> (3 - (i * 5) % 4)) & 31) + 1 as int), 1)), '') as payload_digest
    from p)
select page_id, payload_bytes, payload_digest,
    case when page_id = min(page_id) over w then 'response' else 'revisit' end as record_type,
    case when page_id = min(page_id) over w then null else min(page_id) over w end as refers_to
from d window w as (partition by payload_digest)
"""
