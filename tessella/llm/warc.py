"""Web archives in ZIP packages: writer, directory parser and range reader.

A package holds ``archive/data.warc.gz`` (one gzip member a record) and
``indexes/index.cdxj`` (JSON lines with offset and length), both stored, not
compressed, so that a record is read by its byte range alone. The reader parses
the end record, the ZIP64 end record where there is one, and the central
directory; it never unpacks a member.

Tasks write each package under a new name and report it in their output, so a
package of a lost or repeated task is never read.

Defined results: a null html is an empty payload, a null url an empty one; repeated rows
each have a record, those with the largest id all as responses; rows with a null id have
records and refer to the response like others; payloads of any length are stored whole;
other columns are ignored, whatever they are called; an empty table gives no packages
and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fresh_path, materialise

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the ZIP format: signatures, and lengths of the fixed parts.
EOCD, EOCD64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
EOCD_LEN, LOCATOR_LEN, EOCD64_LEN, CENTRAL_LEN, LOCAL_LEN, MAX_COMMENT = 22, 20, 56, 46, 30, 65535
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Member:
    name: str
    stored: bool
    size: int
    header_offset: int


def filesystem(path: str):
    """pyarrow's file system and the path in it; plain paths are local ones."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class RangeReader:
    """Reads byte ranges of one file."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"range {offset}+{length} is outside the {self.size} bytes of the package")
        self.file.seek(offset)
        return self.file.read(length)


def directory(reader: RangeReader) -> dict[str, Member]:
    """The members that the central directory lists, by name."""
    tail_at = max(0, reader.size - EOCD_LEN - MAX_COMMENT)
    tail = reader.read(tail_at, reader.size - tail_at)
    at = tail.rfind(EOCD)
    while at >= 0 and (len(tail) - at < EOCD_LEN or at + EOCD_LEN + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(EOCD, 0, at)  # the same bytes within a comment
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    end = tail_at + at
    if end >= LOCATOR_LEN and (locator := reader.read(end - LOCATOR_LEN, LOCATOR_LEN))[:4] == LOCATOR64:
        record = reader.read(struct.unpack_from("<Q", locator, 8)[0], EOCD64_LEN)
        if record[:4] != EOCD64:
            raise ValueError("the ZIP64 locator points at no ZIP64 end record")
        entries, length, offset = struct.unpack_from("<QQQ", record, 32)
    raw, at, found = reader.read(offset, length), 0, {}
    for _ in range(entries):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, size = struct.unpack_from("<H", raw, at + 10)[0], *struct.unpack_from("<II", raw, at + 20)
        names, extras, comments = struct.unpack_from("<HHH", raw, at + 28)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + CENTRAL_LEN : at + CENTRAL_LEN + names].decode("utf-8", "replace")
        extra = raw[at + CENTRAL_LEN + names : at + CENTRAL_LEN + names + extras]
        size, packed, header = zip64_values(extra, size, packed, header)
        found[name] = Member(name, method == 0, packed, header)
        at += CENTRAL_LEN + names + extras + comments
    return found


def zip64_values(extra: bytes, size: int, packed: int, header: int) -> tuple[int, int, int]:
    """The 64-bit values stand in the extra field, in this order, for those fields that hold all ones."""
    values, at = [size, packed, header], 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            p = at + 4
            for i, v in enumerate(values):
                if v == 0xFFFFFFFF:
                    values[i] = struct.unpack_from("<Q", extra, p)[0]
                    p += 8
        at += 4 + length
    return values[0], values[1], values[2]


def data_offset(reader: RangeReader, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if not member.stored:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    head = reader.read(member.header_offset, LOCAL_LEN)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    names, extras = struct.unpack_from("<HH", head, 26)
    return member.header_offset + LOCAL_LEN + names + extras


def read_index(reader: RangeReader, members: dict[str, Member], begin: int = 0, length: int | None = None) -> list[dict]:
    """The entries of the index, or of a stretch of its bytes."""
    at = data_offset(reader, members[INDEX])
    text = reader.read(at + begin, members[INDEX].size - begin if length is None else length).decode()
    return [json.loads(line.split(" ", 2)[2]) for line in text.split("\n") if line]


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one gzipped record."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def clean_header(value: str) -> str:
    return " ".join(value.split())


def build_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit that repeats no payload. ``digest``: hex SHA-1 of the payload."""
    revisit = refers_to is not None
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id, digest)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean_header(url or '')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{record_id(refers_to, digest)}>",
            f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
    head += [f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF
    return gzip.compress(raw, compresslevel=1, mtime=0)


class PackageWriter:
    """Writes one package record by record; only the index is held in memory."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.records = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
        self.at, self.index = 0, io.BytesIO()
        self.n, self.lines = 0, []  # where every record's line of the index begins

    def add(self, url: str | None, record: bytes) -> None:
        entry = {"url": url or "", "offset": self.at, "length": len(record)}
        self.lines.append(self.index.tell())
        self.index.write(f"{clean_header(url or '-').replace(' ', '%20') or '-'} 20240101000000 {json.dumps(entry)}\n".encode())
        self.records.write(record)
        self.at += len(record)
        self.n += 1

    def close(self) -> None:
        self.records.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), self.index.getvalue())
        self.zip.close()


def with_revisits(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_bytes: int = 1000, broadcast_rows: int = 100_000,
) -> DataFrame:
    """page_id, url, html, digest, refers_to: of equal payloads of at least
    ``min_bytes`` the one with the largest id is kept and the others refer to it.

    Ties for the largest id are all kept; a null id refers to the largest; a null
    html is an empty payload. Digests that occur once never leave their task.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    chosen = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html")
    ).withColumn("digest", F.sha1("html"))
    repeated = (
        chosen.where(F.octet_length("html") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1 and kept is not null")
        .select("digest", "kept")
    )
    repeated = broadcast_if_small(materialise(repeated, "warc-repeated"), broadcast_rows)
    refers = F.when(F.col("page_id").eqNullSafe(F.col("kept")), None).otherwise(F.col("kept"))
    return chosen.join(repeated, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_packages(records: DataFrame, folder: str, roll_bytes: int = 64 << 20, split: int = 2000) -> DataFrame:
    """Writes ``with_revisits`` rows as packages in ``folder``; returns (path,
    first, n, begin, length) rows, each a run of at most ``split`` records of a package, and the
    bytes of its index that tell where they are."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        writer, sink, name, done = None, None, "", []

        def finish():
            writer.close()
            sink.close()
            marks = [*writer.lines[::split], writer.index.tell()]
            done.extend((f"{folder}/{name}", k * split, min(split, writer.n - k * split), a, b - a) for k, (a, b) in enumerate(zip(marks, marks[1:], strict=False)))

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    sink = files.open_output_stream(f"{root}/{name}", compression=None)
                    writer = PackageWriter(sink)
                writer.add(url, build_record(page_id, url, html.encode(), digest, refers_to))
                if writer.at >= roll_bytes:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        cols = list(zip(*done, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["path", "first", "n", "begin", "length"])

    return materialise(records.mapInArrow(write, "path string, first long, n long, begin long, length long"), "warc-parts")


RECORD_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, url string, record_id string, payload binary"
)


def read_packages(parts: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record, from its byte range. The payload of a response is
    checked against its digest; a revisit has that of the record it refers to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
            ("record_id", pa.string()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for path, begin, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, at = filesystem(path)
                rows = []
                with files.open_input_file(at) as file:
                    reader = RangeReader(file, file.size())
                    members = directory(reader)
                    start = data_offset(reader, members[RECORDS])
                    for entry in read_index(reader, members, begin, length):
                        headers, block = parse_record(reader.read(start + entry["offset"], entry["length"]))
                        rows.append(record_row(headers, block, with_payload))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spread = parts.select("path", "begin", "length").repartition(max(1, min(4096, parts.count())))
    return spread.mapInArrow(read, RECORD_SCHEMA)


def record_row(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    head, _, payload = block.partition(CRLF + CRLF)
    digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    revisit = headers["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"record {headers['warc-record-id']}: its payload does not have its digest")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(headers["warc-page-id"]),
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "record_type": headers["warc-type"],
        "refers_to": number(headers.get("warc-refers-to-page-id")),
        "url": headers["warc-target-uri"],
        "record_id": headers["warc-record-id"].strip("<>"),
        "payload": payload if with_payload and not revisit else None,
    }


def roundtrip(pages: DataFrame) -> DataFrame:
    """Writes the pages to packages in the shared folder and reads them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_packages(write_packages(with_revisits(pages), folder))
