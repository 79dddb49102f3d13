"""Legacy web archives (ARC, versions 1 and 2) to WARC, and WARC read back.

An ARC file is a version block and then records: one header line whose fields
depend on the version, the declared number of bytes, and a line end. The
converter walks a file by those lengths, and makes for each record the WARC
fields that the old format lacks: record id, timestamp, type and digests.

Payloads that were seen before become revisit records. Files are read and
written by Spark, so any store that Spark reaches will do; tasks parse bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.llm.common import shared_dir

# Fixed values of the formats.
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
CRLF, END = b"\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The HTTP field in which our archives carry a row's own key.
KEY_FIELD = "X-Source-Key"
ARC_BYTES = 4 << 20
RECORDS_A_FILE = 20_000


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    offset: int
    block: bytes
    truncated: bool
    kind: str = "response"  # or warcinfo (the version block), or error (the block says what)


def _inflated(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def _header(line: bytes, fields: int) -> list[bytes] | None:
    """Fields of a header line, taken from the right, as URLs may hold spaces; None if it is none."""
    parts = line.rstrip(b"\r\n").rsplit(b" ", fields - 1)
    return parts if len(parts) >= 5 and parts[-1].isdigit() else None


def _plausible(parts: list[bytes] | None) -> bool:
    """Whether a line of unknown place looks like a header: a URL or scheme first, and a date."""
    return parts is not None and b":" in parts[0][:20] and parts[2][:8].isdigit() and len(parts[2]) in (8, 10, 12, 14)


def arc_records(content: bytes, strict: bool = True) -> Iterator[ArcRecord]:
    """Records of one ARC file, plain or gzipped; without ``strict`` also its version blocks and what is damaged.

    The first record names the version, which sets the fields of header lines. A record that ends before
    its declared length is marked truncated. A line that is no header is an error: raised, or
    else told, and the file is read on from the next line that looks like a header. Where a gzipped file
    can't be inflated further, the records before stay.
    """
    f = _inflated(content)
    fields, offset, lost = 5, 0, False
    try:
        while line := f.readline():
            start, offset = offset, offset + len(line)
            if not line.strip():
                continue
            parts = _header(line, fields)
            version_block = line.startswith(b"filedesc:") and b" 0.0.0.0 " in line  # a page may have such a URL
            if version_block:
                parts = line.rstrip(b"\r\n").split(b" ")
                parts = parts if len(parts) >= 5 and parts[-1].isdigit() else None
            if parts is None or lost and not version_block and not _plausible(parts):
                if strict:
                    raise ValueError(f"no ARC header at byte {start}: {line[:80]!r}")
                if not lost:
                    yield ArcRecord("", "", "", "", start, b"no header: " + line[:80].rstrip(), False, "error")
                lost = True
                continue
            lost, length = False, int(parts[-1])
            block = f.read(length)
            offset += len(block)
            url, ip, date, mime = (x.decode("utf-8", "replace") for x in parts[:4])
            if version_block:
                fields = 10 if block.split(None, 1)[:1] == [b"2"] else 5
                if not strict:
                    yield ArcRecord(url, ip, date, mime, start, block, len(block) < length, "warcinfo")
                continue
            yield ArcRecord(url, ip, date, mime, start, block, len(block) < length)
    except (EOFError, OSError, zlib.error) as e:
        if strict:
            raise
        yield ArcRecord("", "", "", "", offset, f"can't be inflated: {e}".encode(), True, "error")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: str) -> str:
    """An ARC date of 14 digits (shorter ones are filled, other signs dropped) as a WARC date."""
    d = re.sub(r"\D", "", date)[:14]
    d += "00000101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its empty line) and payload; a block that is no HTTP response is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    found = re.search(rb"\r?\n\r?\n", block)
    return (block[:found.end()], block[found.end():]) if found else (block, b"")


def _http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


RECORDS = ("record_id string, url string, date string, ip string, mime string, truncated boolean, head binary, payload binary, "
           "payload_digest string, payload_bytes bigint, source_key bigint, kind string, error string")


def convert(arc_files: DataFrame) -> DataFrame:
    """WARC fields of the records of ARC files, given as (path, content), as Spark's binaryFile source reads them.

    Ids are version 5 UUIDs of place, URL and date: another run gives them again.
    Null contents hold no records. ``kind`` is response, warcinfo (a version block) or error: such a row
    says in ``error`` where a file is damaged, and holds no record.
    """
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                for r in arc_records(content.as_py() or b"", strict=False):
                    if r.kind == "error":
                        said = f"{path}, byte {r.offset}: {r.block.decode('utf-8', 'replace')}"
                        rows.append((None, None, None, None, None, r.truncated, b"", b"", None, 0, None, r.kind, said))
                        continue
                    head, payload = split_http(r.block) if r.kind == "response" else (b"", r.block)
                    key = _http_field(head, KEY_FIELD)
                    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{r.offset} {r.date} {r.url}")
                    rows.append((f"<urn:uuid:{rid}>", r.url, warc_date(r.date), r.ip, r.mime, r.truncated, head, payload,
                                 sha1_base32(payload), len(payload), int(key) if key and key.isdigit() else None, r.kind, None))
                    size += len(payload)
                    if size > ARC_BYTES:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return arc_files.select("path", "content").mapInArrow(read, RECORDS)


_TYPES = {"truncated": pa.bool_(), "head": pa.binary(), "payload": pa.binary(), "content": pa.binary(), "record": pa.binary(),
          "payload_bytes": pa.int64(), "source_key": pa.int64(), "refers_to": pa.int64()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def with_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` with first_key, first_id, first_url, first_date: of the first record of an equal payload, null for that first one.

    The first is the one with the smallest source_key (null last, then by record
    id). Payloads below ``min_bytes`` are never revisits. Only digests that occur
    more than once are joined back; as they are written to a file first, Spark knows
    their size and broadcasts them only where that is small.
    """
    spark = records.sparkSession
    first = F.min(F.struct(F.col("source_key").isNull().alias("n"), "source_key", "record_id", "url", "date")).alias("first")
    page = (F.col("kind") == "response") & (F.col("payload_bytes") >= min_bytes)
    seen = (records.filter(page).groupBy("payload_digest")
            .agg(F.count("*").alias("times"), first).filter("times > 1"))
    at = f"{shared_dir(spark)}/repeated-{uuid.uuid4().hex}"
    seen.select("payload_digest", F.col("first.source_key").alias("first_key"), F.col("first.record_id").alias("first_id"),
                F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date")).write.parquet(at)
    joined = records.join(spark.read.parquet(at), "payload_digest", "left")
    again = F.col("first_id").isNotNull() & (F.col("first_id") != F.col("record_id")) & page
    return joined.select(*records.columns, *[F.when(again, F.col(c)).alias(c) for c in ("first_key", "first_id", "first_url", "first_date")])


def warc_record(r: dict) -> bytes:
    """One WARC record, without the two line ends that close it."""
    if r["kind"] == "warcinfo":
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]), ("WARC-Filename", r["url"].rpartition("/")[2]),
                  ("WARC-Block-Digest", "sha1:" + sha1_base32(r["payload"])), ("Content-Type", r["mime"]), ("Content-Length", len(r["payload"]))]
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + CRLF + r["payload"]
    revisit = r["first_id"] is not None
    block = r["head"] + (b"" if revisit else r["payload"])
    kind = "revisit" if revisit else "response"
    http = bool(r["head"])
    fields = [("WARC-Type", kind if http or revisit else "resource"), ("WARC-Record-ID", r["record_id"]), ("WARC-Target-URI", r["url"]),
              ("WARC-Date", r["date"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", "sha1:" + r["payload_digest"]),
              ("WARC-Block-Digest", "sha1:" + sha1_base32(block))]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", r["first_id"]), ("WARC-Refers-To-Target-URI", r["first_url"]),
                   ("WARC-Refers-To-Date", r["first_date"]), ("X-Payload-Length", r["payload_bytes"])]
        fields += [("X-Refers-To-Key", r["first_key"])] * (r["first_key"] is not None)
    fields += [("WARC-Truncated", "length")] * bool(r["truncated"])
    fields += [(KEY_FIELD, r["source_key"])] * (r["source_key"] is not None)
    fields += [("Content-Type", "application/http; msgtype=response" if http else r["mime"]), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + CRLF + block


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (of with_revisits) as gzipped WARC files under ``path``, a file per task and so many records.

    Spark's text writer closes each value with the two line ends that close a record.
    """
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([warc_record(r) for r in batch.slice(at, 200).to_pylist()], pa.binary())], ["value"])

    (records.mapInArrow(render, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path))


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (lower-case names) and block of each record of a WARC file, plain or gzipped."""
    f = _inflated(content)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, f.read(int(fields["content-length"]))


READ = "record_id string, url string, record_type string, source_key bigint, refers_to bigint, payload_digest string, payload_bytes bigint"


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the WARC files under ``path`` but warcinfo; digests of stored payloads are computed anew and must match."""
    spec = READ + ", payload binary" * with_payload
    names = [x.split()[0] for x in spec.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in warc_records(content.as_py()):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    head, payload = split_http(block)
                    if kind == "revisit":
                        digest, n = said, int(fields["x-payload-length"])
                    elif (digest := sha1_base32(payload)) != said:
                        raise ValueError(f"digest of {fields['warc-record-id']} differs")
                    else:
                        n = len(payload)
                    keys = [int(fields[k]) if k in fields else None for k in (KEY_FIELD.lower(), "x-refers-to-key")]
                    rows.append((fields["warc-record-id"], fields["warc-target-uri"], kind, *keys, digest, n, *[payload] * with_payload))
                    size += len(payload) * with_payload
                    if size > ARC_BYTES or len(rows) > 10_000:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, spec)


def arc_files(pages: DataFrame, date: str = "20240101000000", ip: str = "192.0.2.1") -> DataFrame:
    """Legacy archives (path, content) of pages (page_id, url, html): ARC files of about ARC_BYTES, of version 1 and 2 in turn.

    The page's key goes in an HTTP field. Null html is an empty payload; null URLs
    are written as "-", and white space inside a URL is percent-encoded, as a header line
    has spaces between its fields.
    """
    def file(n: int, rows: list[tuple]) -> tuple[str, bytes]:
        version = n % 2 + 1
        name = f"legacy-{rows[0][0]}-{n}.arc"
        about = f"{version} 0 pathweave\n{V2_FIELDS if version == 2 else V1_FIELDS}\n".encode()
        middle = f"200 - - 0 {name} " if version == 2 else ""
        out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {middle}{len(about)}\n".encode(), about, b"\n"]
        at = sum(map(len, out))
        for key, url, html in rows:
            body = (html or "").encode()
            mine = f"{KEY_FIELD}: {key}\r\n" if key is not None else ""
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{mine}\r\n".encode()
            clean = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "-")
            middle = f"200 - - {at} {name} " if version == 2 else ""
            line = f"{clean} {ip} {date} text/html {middle}{len(head) + len(body)}\n".encode()
            out += [line, head, body, b"\n"]
            at += len(line) + len(head) + len(body) + 1
        return name, b"".join(out)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            rows, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[2] or "")
                if size > ARC_BYTES:
                    yield _batch([file(n, rows)], ["path", "content"])
                    rows, size, n = [], 0, n + 1
            if rows:
                yield _batch([file(n, rows)], ["path", "content"])
                n += 1

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        write, "path string, content binary")


def arc_to_warc(arc: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Convert ARC files (path, content) into WARC files under ``path``; equal payloads become revisits, version blocks warcinfo.

    Returns (error): one row for each place where a file is damaged; the records around it are converted.
    """
    at = f"{shared_dir(arc.sparkSession)}/records-{uuid.uuid4().hex}"
    convert(arc).write.option("compression", "zstd").parquet(at)  # parsed and digested once, used twice
    records = arc.sparkSession.read.parquet(at)
    write_warc(with_revisits(records.filter("error is null"), min_bytes), path)
    return records.filter("error is not null").select("error")
