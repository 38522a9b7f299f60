"""Legacy ARC archives, their conversion into WARC, and the way back to rows.

ARC files begin with a ``filedesc`` record whose block names the version and
the fields of a header line; every record is a header line, a block of the
declared length, and a newline. The converter parses header lines by the
version's fields and takes blocks by their declared length alone, whatever
they hold, and synthesises WARC records: identifiers from the archive's path
and the record's offset, timestamps from the 14-digit dates, ``warcinfo`` /
``response`` / ``resource`` / ``revisit`` types, payload and block digests.

Archives are read whole by Spark's binary source (one archive is the unit of a
task and must stay below 2 GB, so writers roll them) and written by its text
sink, whose line separator is the record separator of the format; both work on
every file system that Spark can reach. Which record stands for equal payloads
is decided on digests alone; payloads are never shuffled for it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import materialise

#: records of an archive before the next one begins
ARCHIVE_RECORDS = 10_000
MIN_REVISIT_BYTES = 1000
CAPTURED = "19970101000000"
PAGE_HEADER = b"X-Page-Id"
NO_URL = "urn:x-no-url"
ORIGIN = "cohortlens"
BATCH_BYTES = 4 << 20
# fixed values of the formats
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "archive string, seq bigint, record_id string, uri string, date string, page_id bigint, payload_bytes bigint, sha256 string"
READ = ("record_id string, record_type string, page_id bigint, payload_bytes bigint, payload_digest string, "
        "refers_id string, uri string, date string")


class ArchiveError(ValueError):
    """An archive that breaks its format; names the archive and the offset."""


def _stream(raw: bytes) -> io.BufferedIOBase:
    """The archive's bytes, gzip members (of a record or of the file) unpacked."""
    return gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)


def arc_records(raw: bytes, name: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, header fields, block)`` of every record, ``filedesc`` ones included.

    Offsets count unpacked bytes. Header lines are split from the right, so a
    URL with blanks stays whole. Without a ``filedesc`` version 1 is assumed.
    """
    stream, at, names = _stream(raw), 0, ARC_FIELDS[1].split()
    while line := stream.readline():
        start, at = at, at + len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            continue
        described = text.startswith("filedesc://")
        length = text.rpartition(" ")[2]
        if not length.isdigit():
            raise ArchiveError(f"{name}, offset {start}: no declared length in {text[:80]!r}")
        block = stream.read(int(length))
        if len(block) != int(length):
            raise ArchiveError(f"{name}, offset {start}: {length} bytes declared, {len(block)} found")
        at += len(block)
        if described:
            lines = block.decode("utf-8", "replace").splitlines()
            version = int(lines[0].split()[0]) if lines and lines[0][:1].isdigit() else 1
            names = lines[1].split() if len(lines) > 1 and lines[1].strip() else ARC_FIELDS[version].split()
            values = text.split(" ")
            fields = {"URL": values[0], "Archive-date": values[2] if len(values) > 2 else CAPTURED, "Version": str(version)}
        else:
            values = text.rsplit(" ", len(names) - 1)
            if len(values) != len(names):
                raise ArchiveError(f"{name}, offset {start}: {len(values)} of {len(names)} fields in {text[:80]!r}")
            fields = dict(zip(names, values))
        yield start, fields, block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP response."""
    found = re.search(rb"\r?\n\r?\n", block)
    return (block[:found.end()], block[found.end():]) if found else (block, b"")


def http_field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("latin-1").strip() if found else None


def record_id(archive: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}"


def warc_date(arc_date: str) -> str:
    """``YYYYMMDDhhmmss`` (cut ones filled up) as an ISO time."""
    d = (arc_date if arc_date.isdigit() else CAPTURED)[:14]
    d += "00000101000000"[len(d):]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without the separator behind it."""
    lines = [WARC_VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def converted(archive: str, offset: int, fields: dict[str, str], block: bytes, info: str | None,
              original: tuple[str, str, str] | None) -> bytes:
    """The WARC record of an ARC record; ``original`` (id, URI, date) makes it a revisit."""
    rid, date, url = record_id(archive, offset), warc_date(fields.get("Archive-date", "")), fields["URL"]
    if url.startswith("filedesc://"):
        body = (f"software: {ORIGIN}\r\nformat: WARC File Format 1.1\r\n"
                f"description: converted from ARC version {fields['Version']}\r\n").encode()
        return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", date),
                            ("WARC-Filename", url[len("filedesc://"):]), ("Content-Type", "application/warc-fields")], body)
    ip = fields.get("IP-address")
    common = [("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
              ("WARC-IP-Address", ip if ip not in (None, "-", "0.0.0.0") else None),
              ("WARC-Warcinfo-ID", f"<{info}>" if info else None)]
    if not block.startswith(b"HTTP/"):
        return warc_record([("WARC-Type", "resource"), *common, ("WARC-Payload-Digest", sha1_base32(block)),
                            ("Content-Type", fields.get("Content-type", "application/octet-stream"))], block)
    head, payload = split_http(block)
    kind, kept = [("WARC-Type", "response")], block
    if original:
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{original[0]}>"),
                ("WARC-Refers-To-Target-URI", original[1]), ("WARC-Refers-To-Date", original[2])]
        kept = head
    return warc_record([*kind, *common, ("WARC-Payload-Digest", sha1_base32(payload)), ("WARC-Block-Digest", sha1_base32(kept)),
                        ("Content-Type", "application/http; msgtype=response")], kept)


def warc_records(raw: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(header fields in lower case, block)`` of every record, by declared lengths."""
    stream = _stream(raw)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"{name}: {line[:40]!r} where a record should begin")
        fields = {}
        while (line := stream.readline()).strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ArchiveError(f"{name}: {length} bytes declared, {len(block)} found in {fields.get('warc-record-id')}")
        yield fields, block


def _written(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])


def _rows(kind: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in kind.split(", ")]
    types = {"string": pa.string(), "bigint": pa.int64()}

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], types[t]) for k, (_, t) in enumerate(fields)],
                                          names=[n for n, _ in fields])

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def write_arc(pages: DataFrame, path: str, records: int = ARCHIVE_RECORDS, captured: str = CAPTURED) -> None:
    """Write ``pages(page_id, url, html)`` as gzip ARC archives, versions 1 and 2 in turn.

    Each partition writes its own archives of ``records`` pages, without a
    shuffle. The page id travels as an HTTP header (none if null). A null html
    is an empty payload, a null or empty url becomes ``NO_URL``; blanks and
    other characters that a header line can't hold are percent-encoded.
    """
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        part, count, offset, name = TaskContext.get().partitionId(), 0, 0, ""
        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):
                version = 1 + (part + count // records) % 2
                if count % records == 0:
                    name = f"{ORIGIN}-{part:05d}-{count // records:05d}.arc"
                    about = f"{version} 0 {ORIGIN}\n{ARC_FIELDS[version]}\n".encode()
                    more = f"200 - - 0 {name} " if version == 2 else ""
                    first = f"filedesc://{name} 0.0.0.0 {captured} text/plain {more}{len(about)}\n".encode() + about
                    yield first
                    offset = len(first) + 1
                html = html or b""
                own = b"" if page_id is None else PAGE_HEADER + f": {page_id}\r\n".encode()
                block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n" + own
                         + f"Content-Length: {len(html)}\r\n\r\n".encode() + html)
                url = quote(url, safe="%!#$&'()*+,/:;=?@[]~<>\"{}|\\^`") if url else NO_URL
                more = f"200 - - {offset} {name} " if version == 2 else ""
                record = f"{url} 0.0.0.0 {captured} text/html {more}{len(block)}\n".encode() + block
                yield record
                offset += len(record) + 1
                count += 1

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("binary"))
    # a filedesc comes before every `records` pages, so files of records + 1 rows begin with one
    (rows.mapInArrow(lambda batches: _written(lines(batches)), "record binary").select(F.col("record").cast("string"))
     .write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records + 1).text(path))


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        F.col("path").alias("archive"), "content")


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """``RECORD`` row of every HTTP record of the ARC archives in ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for archive, raw in zip(b.column(0).to_pylist(), b.column(1)):
                    for seq, (offset, fields, block) in enumerate(arc_records(raw.as_py(), archive)):
                        if block.startswith(b"HTTP/"):
                            head, payload = split_http(block)
                            page = http_field(head, PAGE_HEADER)
                            yield (archive, seq, record_id(archive, offset), fields["URL"], warc_date(fields["Archive-date"]),
                                   int(page) if page else None, len(payload), hashlib.sha256(payload).hexdigest())
        return _rows(RECORD, rows())

    return _archives(spark, path).mapInArrow(run, RECORD)


def revisits(index: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``archive, seq, original(id, uri, date)`` of the records that revisit another one.

    Of records with equal payloads of at least ``min_bytes`` the one with the
    largest page id stands (of equal ids the last one in its archives). Only
    payloads that occur twice are joined back, by digest and length.
    """
    sized = index.where(F.col("payload_bytes") >= min_bytes)
    chosen = sized.groupBy("sha256", "payload_bytes").agg(
        F.count("*").alias("n"), F.max(F.struct("page_id", "archive", "seq", "record_id", "uri", "date")).alias("o"))
    chosen = chosen.where("n > 1").select("sha256", "payload_bytes", "o")
    original = F.struct(F.col("o.record_id").alias("id"), F.col("o.uri").alias("uri"), F.col("o.date").alias("date"))
    return (sized.select("archive", "seq", "record_id", "sha256", "payload_bytes").join(chosen, ["sha256", "payload_bytes"])
            .where(F.col("record_id") != F.col("o.record_id")).select("archive", "seq", original.alias("original")))


def convert(spark: SparkSession, arc_path: str, warc_path: str, repeats: DataFrame) -> None:
    """Write the ARC archives in ``arc_path`` as gzip WARC files; ``repeats`` as :func:`revisits` gives them."""
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for b in batches:
            for archive, raw, known in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                originals = {k["seq"]: k["original"] for k in known.as_py() or ()}
                info = None
                for seq, (offset, fields, block) in enumerate(arc_records(raw.as_py(), archive)):
                    if fields["URL"].startswith("filedesc://"):
                        info = record_id(archive, offset)
                    o = originals.get(seq)
                    yield converted(archive, offset, fields, block, info, (o["id"], o["uri"], o["date"]) if o else None)

    # at most an archive's records in one list
    per_archive = repeats.groupBy("archive").agg(F.collect_list(F.struct("seq", "original")).alias("known"))
    rows = _archives(spark, arc_path).join(per_archive, "archive", "left").select("archive", "content", "known")
    (rows.mapInArrow(lambda batches: _written(records(batches)), "record binary").select(F.col("record").cast("string"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_path))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``READ`` row of every response and revisit record of the WARC files in ``path``.

    ``payload_bytes`` of a revisit is the length that its HTTP head states. A
    response whose payload doesn't have its digest is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for archive, raw in zip(b.column(0).to_pylist(), b.column(1)):
                    for fields, block in warc_records(raw.as_py(), archive):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        head, payload = split_http(block)
                        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ArchiveError(f"{archive}: payload of {fields['warc-record-id']} doesn't have its digest")
                        stated, page = http_field(head, b"Content-Length"), http_field(head, PAGE_HEADER)
                        size = len(payload) if kind == "response" else int(stated) if stated else None
                        refers = fields.get("warc-refers-to")
                        yield (fields["warc-record-id"].strip("<>"), kind, int(page) if page else None, size, digest,
                               refers.strip("<>") if refers else None, fields.get("warc-target-uri"), fields["warc-date"])
        return _rows(READ, rows())

    return _archives(spark, path).mapInArrow(run, READ)


def page_records(read: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, uri, date`` per record.

    A revisit's ``refers_to`` is the page id of the record that it names.
    """
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "uri", "date"]
    responses = read.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("bigint"))
    target = read.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full"))
    again = read.where("record_type = 'revisit'").join(target, "refers_id", "left")
    again = again.withColumn("payload_bytes", F.coalesce("payload_bytes", "full"))
    return responses.select(*columns).unionByName(again.select(*columns))


def through_archives(pages: DataFrame, records: int = ARCHIVE_RECORDS) -> DataFrame:
    """Write ``pages`` as ARC, convert to WARC, read back: :func:`page_records`.

    One row per row of ``pages(page_id, url, html)``. Repeated rows are
    records of their own; a null page id comes back null and stands for equal
    payloads only if all of them are null. An empty table gives no rows.
    Further columns are ignored.
    """
    spark = pages.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    write_arc(pages, f"{base}/arc", records)
    index = materialise(arc_index(spark, f"{base}/arc"), "archives-index")
    convert(spark, f"{base}/arc", f"{base}/warc", revisits(index))
    return page_records(materialise(read_warc(spark, f"{base}/warc"), "archives-read"))
