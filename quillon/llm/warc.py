"""Legacy archive converter: ARC records become WARC records, archives are written and read back by Spark.

ARC has no record marks: a header line, whose fields depend on the version that the file's first block
declares, gives the length of what follows. The converter walks an archive by these lengths and makes up
what WARC asks for and ARC lacks: record ids, ISO timestamps, record types and payload digests.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import group_join, shared_dir, written

#: Payloads below this many bytes are always stored in full.
MIN_REVISIT_BYTES = 1000
#: An archive that is built in memory ends after so many bytes; one longer record is an archive of its own.
ARCHIVE_BYTES = 4 << 20
#: The same for WARC archives.
WARC_BYTES = 64 << 20
#: Capture time of pages, which have none of their own.
CAPTURED = "20240101000000"
#: Date of the warcinfo records.
WRITTEN = "2024-01-01T00:00:00Z"

# The fields of a header line by ARC version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_RECORD = "page_id bigint, url string, ip string, warc_date string, mime string, http string, payload binary, payload_bytes bigint, digest string, record_id string"
_READ = "page_id bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, digest string, whole boolean, record_id string, refers_to_record string"


def _line(url: str, ip: str, date: str, mime: str, length: int, version: int) -> bytes:
    values = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": mime, "Archive-length": str(length), "Result-code": "200"}
    return (" ".join(values.get(f, "-") for f in ARC_FIELDS[version]) + "\n").encode()


def arc_start(version: int, name: str = "quillon.arc") -> bytes:
    """The block that begins an archive and declares its version."""
    body = f"{version} 0 quillon\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return _line(f"filedesc://{name}", "0.0.0.0", CAPTURED, "text/plain", len(body), version) + body + b"\n"


def arc_record(url: str | None, body: bytes, version: int, ip: str = "0.0.0.0", date: str = CAPTURED, mime: str = "text/html") -> bytes:
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")
    return _line(clean, ip, date, mime, len(body), version) + body + b"\n"


def parse_arc(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record of an archive, without the block that declares its version.

    A line with fewer fields than the version asks for, or a length beyond the end, is an error: what
    follows could not be told apart.
    """
    at, fields = 0, None
    while at < len(blob):
        if blob[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = blob.index(b"\n", at)
        line = blob[at:end].decode("utf-8", "replace").rstrip("\r")
        length = int(line.rsplit(" ", 1)[1])
        body = blob[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"record at byte {at} declares {length} bytes and has {len(body)}")
        if fields is None:
            if not line.startswith("filedesc:"):
                raise ValueError("an ARC archive begins with a filedesc line")
            fields = ARC_FIELDS[int(body.split(b" ", 1)[0])]
        else:
            values = line.rsplit(" ", len(fields) - 1)  # the URL is all that may hold blanks
            if len(values) < len(fields):
                raise ValueError(f"record at byte {at} has {len(values)} fields")
            yield dict(zip(fields, values, strict=True)), body
        at = end + 1 + length


def pages_to_arc(pages: DataFrame, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Archives (archive binary) of pages (page_id, url, html); archives of the given versions take turns.

    Each body is an HTTP response, with the page's id in a field of its own; null html is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        parts: list[bytes] = []
        size = 0
        for batch in batches:
            for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                version = versions[made % len(versions)]
                payload = (html.as_py() or "").encode()
                own = f"X-Page-Id: {page.as_py()}\r\n" if page.is_valid else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
                parts.append(arc_record(url.as_py(), head.encode() + payload, version))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([arc_start(version) + b"".join(parts)], pa.binary())], names=["archive"])
                    made, parts, size = made + 1, [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([arc_start(versions[made % len(versions)]) + b"".join(parts)], pa.binary())], names=["archive"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "archive binary")


def convert_arc(archives: DataFrame, column: str = "archive") -> DataFrame:
    """What WARC records need, for each ARC record of the archives (``content`` of Spark's binaryFile source will do)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                rows = []
                for fields, body in parse_arc(blob.as_py() or b""):
                    head, _, payload = body.partition(b"\r\n\r\n")
                    if not head.startswith(b"HTTP/"):
                        head, payload = b"", body
                    http = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
                    digest = hashlib.sha1(payload).hexdigest()
                    page, date = http.get("X-Page-Id"), fields["Archive-date"].ljust(14, "0")
                    rows.append(
                        {
                            "page_id": int(page) if page else None, "url": fields["URL"], "ip": fields["IP-address"], "mime": fields["Content-type"],
                            "warc_date": f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z",
                            "http": head.decode("latin-1"), "payload": payload, "payload_bytes": len(payload), "digest": digest,
                            "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['URL']} {date} {page} {digest}")),
                        }
                    )
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 256], _arrow_schema)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    _arrow_schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in _RECORD.split(", "))])
    return archives.select(column).mapInArrow(run, _RECORD)


def with_record_types(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Records with record_type, refers_to and first: record_id, url and warc_date of the response that a revisit refers to.

    Of records with equal payloads of at least ``min_bytes`` that with the largest page_id is the
    response and the others revisit it; ties on that id are all responses, and so are records without id.
    Digests are counted first; those of very many pages are joined back by a broadcast of bounded size.
    """
    large = records.select("page_id", "digest", "payload_bytes", F.struct("record_id", "url", "warc_date").alias("own")).filter((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    groups = large.groupBy("digest", "payload_bytes").agg(F.max(F.struct("page_id", "own")).alias("top"), F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("least < top.page_id")
    groups = written(groups.select("digest", "payload_bytes", F.col("top.page_id").alias("refers_to"), F.col("top.own").alias("first"), "n"), "payloads")
    revisits = group_join(large.drop("own"), groups, ["digest", "payload_bytes"], "n", large.count()).filter("page_id < refers_to").select("page_id", "digest", "refers_to", "first").distinct()
    joined = records.join(revisits, ["page_id", "digest"], "left")
    return joined.withColumn("record_type", F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit")))


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A record without the two line ends after it; fields that are None are left out."""
    lines = [f"{name}: {value}" for name, value in fields.items() if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def _typed_record(r: dict, info: str) -> bytes:
    full, first = r["record_type"] == "response", r["first"] or {}
    head = r["http"].encode("latin-1") + b"\r\n\r\n" if r["http"] else b""
    fields = {
        "WARC-Type": r["record_type"] if head or not full else "resource", "WARC-Record-ID": f"<urn:uuid:{r['record_id']}>", "WARC-Warcinfo-ID": info, "WARC-Date": r["warc_date"],
        "WARC-Target-URI": r["url"], "WARC-IP-Address": r["ip"], "WARC-Payload-Digest": f"sha1:{r['digest']}",
        "WARC-Profile": None if full else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        "WARC-Refers-To": None if full else f"<urn:uuid:{first['record_id']}>", "WARC-Refers-To-Target-URI": None if full else first["url"], "WARC-Refers-To-Date": None if full else first["warc_date"],
        "X-Page-Id": None if r["page_id"] is None else str(r["page_id"]), "X-Refers-To-Page": None if full else str(r["refers_to"]), "X-Payload-Bytes": str(r["payload_bytes"]),
        "Content-Type": "application/http; msgtype=response" if head else r["mime"],
    }
    return warc_record(fields, head + r["payload"] if full else head)


def write_warc(records: DataFrame, path: str, archive_bytes: int = WARC_BYTES) -> None:
    """Write typed records as gzipped WARC archives, each with a warcinfo record first.

    An archive ends after ``archive_bytes`` (before compression), so that it can be read as one value; only a
    longer record makes a longer archive. A partition without records writes none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, info = [], 0, None

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(out)], pa.binary())], names=["value"])

        for batch in batches:
            for at in range(0, len(batch), 16):
                for r in batch.slice(at, 16).to_pylist():
                    if not out:
                        info = f"<urn:uuid:{uuid.uuid4()}>"
                        head = {"WARC-Type": "warcinfo", "WARC-Record-ID": info, "WARC-Date": WRITTEN, "Content-Type": "application/warc-fields"}
                        out.append(warc_record(head, b"software: quillon\r\nformat: WARC File Format 1.1\r\n"))
                    out.append(_typed_record(r, info))
                    size += len(out[-1])
                    if size >= archive_bytes:
                        yield archive()
                        out, size = [], 0
        if out:
            yield archive()

    rows = records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))  # the cast keeps all bytes
    # A row is an archive, and a file has one row.
    rows.write.option("maxRecordsPerFile", 1).option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed archive, by declared lengths.

    Line ends between records may be any number. A record cut short is an error.
    """
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:20]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip()] = value.strip()
        length = int(fields["Content-Length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"a record declares {length} bytes and has {len(block)}")
        yield fields, block


def opened(blob: bytes) -> BinaryIO:
    """An archive as a stream: as it is, or unpacked where it is gzipped, as a whole or record by record."""
    return gzip.GzipFile(fileobj=io.BytesIO(blob)) if blob[:2] == b"\x1f\x8b" else io.BytesIO(blob)


def read_warc(spark, path: str) -> DataFrame:
    """The records of WARC archives: page_id, record_type, refers_to, url, payload_bytes, digest, whole, record_id, refers_to_record.

    Any WARC archive can be read; warcinfo records are left out. page_id and refers_to come from fields that
    write_warc adds and are null in others' archives. payload_bytes and digest of a record with a payload are
    those of the payload read, and whole tells whether it has the declared digest; of a revisit they are declared.
    """

    def row(h: dict[str, str], block: bytes) -> tuple:
        size, digest, whole = int(h.get("X-Payload-Bytes", -1)), h.get("WARC-Payload-Digest", "").removeprefix("sha1:"), True
        if h.get("WARC-Type") != "revisit":
            payload = block.partition(b"\r\n\r\n")[2] if h.get("Content-Type", "").startswith("application/http") else block
            found = hashlib.sha1(payload).hexdigest()
            whole, size, digest = digest in ("", found) and size in (-1, len(payload)), len(payload), found
        page, refers, plain = h.get("X-Page-Id"), h.get("X-Refers-To-Page"), lambda x: x and x.strip("<>").removeprefix("urn:uuid:")
        return (int(page) if page else None, h.get("WARC-Type"), int(refers) if refers else None, h.get("WARC-Target-URI"), size, digest, whole, plain(h.get("WARC-Record-ID")), plain(h.get("WARC-Refers-To")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string())
        for batch in batches:
            for blob in batch.column(0):
                records = (row(h, block) for h, block in parse_warc(opened(blob.as_py())) if h.get("WARC-Type") != "warcinfo")
                while rows := list(islice(records, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[f.split()[0] for f in _READ.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) by way of ARC archives into WARC archives and back: one row for each page.

    Null html is an empty payload; a null url is about:blank; a page without id is a response. Repeated
    rows are records of their own, and pages of any length are one record. Other columns of ``pages`` are not
    archived: the result has the columns of ``read_warc`` only. An empty table gives no records and no rows.
    """
    spark = pages.sparkSession
    records = with_record_types(written(convert_arc(pages_to_arc(pages)), "records", "zstd"))
    path = f"{shared_dir(spark)}/quillon-warc-{uuid.uuid4().hex}"
    write_warc(records, path)
    return read_warc(spark, path)
