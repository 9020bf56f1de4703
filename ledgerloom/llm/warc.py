"""WARC archives: a writer of response and revisit records, and a reader that salvages damaged files.

The writer lays every record out as a gzip member of its own. Of records with equal payloads of at
least ``REVISIT_BYTES`` bytes, the one with the largest page_id is written in full; the others become
revisit records that refer to it.

The reader goes through a file member by member, or record by record where it is not compressed. A
member that does not inflate, a bad checksum, a header that does not parse, a length that does not lead
to the end of a record, or a payload with another digest fails the check; then the reader searches for
the next position at which a valid member or version line starts, goes on from there and reports the
bytes between as a gap. Records after a damaged place are recovered, and every byte of a file belongs
either to a record, to padding between records, or to a reported gap.

In a member of several records, those that pass are kept, also from the part inflated before a fault,
and the search goes on in its content. Its records and gaps carry the place of the member, and a gap's
reason tells the bytes of the content. Where the member does not inflate to its checksum, only records
with a payload digest that fits are kept. A lone record whose member fails is not: the checksum is its own.

Defined results: null html is an empty payload. A row with a null page_id is written under no number;
if its payload has a numbered copy it revisits that, else it is a response. Rows that repeat the largest
page_id of a payload are all responses. A null URL has no target header. Control characters in URLs are
percent-encoded. An empty table writes no record. Other columns are ignored, whatever their names.

A file is read whole by one task, so the writer starts a new file after about ``FILE_BYTES`` bytes of
payload (counted with the average size of a payload).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import slices
from ledgerloom.session import scratch_folder

REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
# An empty gzip member. It separates the rows of the file writer, which has to put something between.
SEPARATOR = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])

_MEMBER, _VERSION = b"\x1f\x8b\x08", b"WARC/1."
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_STEP = 1 << 16


# --- writing ------------------------------------------------------------------------------


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None
) -> bytes:
    """The bytes of one record; ``digest`` is the payload's SHA-1 in hex."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % (
        len(payload)
    )
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(4, "WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _members(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for batch in slices(part, 512):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([member(record(*row)) for row in rows], pa.binary())], names=["value"]
            )


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """One record per page, in as many files below ``path`` as the table's partitions need."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= revisit_bytes
    sizes = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes")).first()
    # Only payloads that occur more than once; combined before the shuffle.
    copies = (
        rows.where(large)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    known = F.when(large & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    written = (
        rows.join(copies, F.col("digest") == F.col("_digest"), "left")
        .select("page_id", "url", "payload", "digest", known.alias("refers_to"))
        .mapInArrow(_members, "value binary")
    )
    average = (sizes["bytes"] or 0) / max(1, sizes["n"])
    (
        written.select(F.col("value").cast("string"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", SEPARATOR.decode("latin-1"))
        .option("maxRecordsPerFile", max(1, int(FILE_BYTES / max(1024.0, average))))
        .text(path)
    )


# --- reading ------------------------------------------------------------------------------


@dataclass
class Found:
    """A record, or a gap if ``kind`` is ``gap``."""

    kind: str
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    http: bytes = b""
    payload: bytes = b""
    reason: str | None = None


class Damaged(ValueError):
    """``kept`` are records and gaps found in the content of a member that does not end well, and
    ``fault`` is the offset up to which it was inflated."""

    def __init__(self, reason: str, kept: list[Found] | None = None, fault: int = 0) -> None:
        super().__init__(reason)
        self.kept, self.fault = kept or [], fault


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The content of the member at ``at``, the offset after it, and what is wrong with it.

    If anything is, content and offset are those up to the fault.
    """
    start, unpacker, parts = at, zlib.decompressobj(31), []
    while not unpacker.eof:
        piece = data[at : at + _STEP]
        if not piece:
            return b"".join(parts), at, "member cut short"
        try:
            parts.append(unpacker.decompress(piece))
        except zlib.error:
            # The same again, and the last piece byte by byte: what it holds before the fault.
            unpacker = zlib.decompressobj(31)
            for place in range(start, at, _STEP):
                unpacker.decompress(data[place : place + _STEP])
            try:
                for place in range(at, at + len(piece)):
                    at = place
                    parts.append(unpacker.decompress(data[place : place + 1]))
            except zlib.error:
                pass
            return b"".join(parts), at, "member does not inflate"
        at += len(piece) - len(unpacker.unused_data)
    return b"".join(parts), at, None


def _parse(data: bytes, at: int, end: int) -> tuple[Found, int]:
    """The record at ``at`` and the offset after it."""
    if not _VERSION_LINE.match(data, at, end):
        raise Damaged("no version line")
    close = data.find(b"\r\n\r\n", at, end)
    if close < 0:
        raise Damaged("header without end")
    headers = {}
    for line in data[at:close].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", size):
        raise Damaged("no content length")
    start, stop = close + 4, close + 4 + int(size)
    if stop + 4 > end or data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("length does not lead to the end of a record")
    found = Found("record", at, stop + 4 - at, headers, b"", data[start:stop])
    if headers.get("content-type", "").startswith("application/http"):
        head, blank, body = found.payload.partition(b"\r\n\r\n")
        found.http, found.payload = head + blank, body
    said = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and said.startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(found.payload).digest()).decode() != said[5:]:
            raise Damaged("payload has another digest")
    return found, stop + 4


def _has_digest(found: Found) -> bool:
    """Whether a record that was parsed had a payload digest to fit."""
    said = found.headers.get("warc-payload-digest", "")
    return found.headers.get("warc-type") != "revisit" and said.startswith("sha1:")


def _inside(content: bytes, fault: str | None) -> list[Found]:
    """Records and gaps of a member's content in order, at their places in it."""
    out, at, size = [], 0, len(content)
    lost, reason = -1, None
    while at < size:
        try:
            found, after = _parse(content, at, size)
            if fault == "member does not inflate" and not _has_digest(found):
                raise Damaged("no digest to tell a record by")
        except Damaged as error:
            if lost < 0:
                lost, reason = at, str(error)
            at = content.find(_VERSION, at + 1)
            at = size if at < 0 else at
            continue
        if lost >= 0:
            out.append(Found("gap", lost, at - lost, reason=reason))
            lost = -1
        out.append(found)
        at = after
    if lost >= 0:
        out.append(Found("gap", lost, size - lost, reason=reason))
    return out


def _valid(data: bytes, view: memoryview, at: int) -> tuple[list[Found], int]:
    """Records and gaps of the member, or the plain record, at ``at`` and the offset after it."""
    if not data.startswith(_MEMBER, at):
        found, after = _parse(data, at, len(data))
        return [found], after
    content, after, fault = _inflate(view, at)
    inside = _inside(content, fault)
    if not any(f.kind == "record" for f in inside):
        if fault or inside:
            raise Damaged(fault or inside[0].reason)
    elif fault and len(inside) == 1:
        raise Damaged(fault)
    for f in inside:
        if f.kind == "gap":
            f.reason += f" (bytes {f.offset} to {f.offset + f.length} of the member's content)"
        f.offset, f.length = at, after - at
    if fault:
        if inside[-1].kind == "gap":
            # What fails last is where the member ends; the gap up to the next valid start tells it.
            fault += f"; {inside.pop().reason}"
        raise Damaged(fault, inside, after)
    return inside, after


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of a file in order."""
    view, at, size = memoryview(data), 0, len(data)
    lost, reason, kept, fault = -1, None, [], 0

    def close(stop: int) -> Iterator[Found]:
        for found in kept:
            found.length = stop - found.offset
        yield from kept
        yield Found("gap", lost, stop - lost, reason=reason)

    while at < size:
        try:
            records, after = _valid(data, view, at)
        except Damaged as error:
            if error.kept and lost >= 0:
                yield from close(at)
                lost = -1
            if lost < 0:
                lost, reason, kept, fault = at, str(error), error.kept, error.fault
            start = _START.search(data, at + 1)
            at = start.start() if start else size
            continue
        if at < fault and any(
            (f.headers, f.payload) == (k.headers, k.payload) for f in records for k in kept if k.kind == "record"
        ):
            # A record that its member stores as it is, and that has been found in it.
            at = after
            continue
        if lost >= 0:
            yield from close(at)
            lost, kept, fault = -1, [], 0
        yield from records
        at = after
    if lost >= 0:
        yield from close(size)


_SCHEMA = (
    "path string, kind string, offset bigint, length bigint, reason string, record_type string, "
    "record_id string, target_uri string, refers_to string, payload_bytes bigint, "
    "payload_digest string, payload binary"
)


def _row(path: str, found: Found, with_payload: bool) -> tuple:
    head = found.headers
    if found.kind == "gap":
        return (path, "gap", found.offset, found.length, found.reason, *[None] * 7)
    size, digest = len(found.payload), hashlib.sha1(found.payload).hexdigest()
    if head.get("warc-type") == "revisit":
        # The response's own header tells the length of the payload that is not repeated.
        told = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", found.http)
        size = int(told[1]) if told else None
        said = head.get("warc-payload-digest", "")
        digest = base64.b32decode(said[5:]).hex() if re.fullmatch(r"sha1:[A-Z2-7]{32}", said) else None
    return (
        path, "record", found.offset, found.length, None, head.get("warc-type"),
        head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"),
        size, digest, found.payload if with_payload else None,
    )


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record and every gap of the files below ``path``."""
    kinds = [
        pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
        pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(),
    ]
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

        for batch in parts:
            for place, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for found in salvage(content.as_py()):
                    rows.append(_row(place, found, with_payload))
                    if len(rows) == 512:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(read, _SCHEMA)


def quarantine(archive: DataFrame, path: str) -> None:
    """Append the byte gaps of ``read_archives`` to the log at ``path``."""
    archive.where("kind = 'gap'").select("path", "offset", "length", "reason").write.mode("append").json(path)


def page_number(name):
    """The page_id of a record name, or null."""
    return F.nullif(F.regexp_extract(name, r"^<urn:x-page:(-?[0-9]+)>$", 1), F.lit("")).cast("bigint")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and tell what the archives hold."""
    spark = pages.sparkSession
    path = f"{scratch_folder(spark, 'llm-warc')}/files"
    write_archives(pages, path)
    return read_archives(spark, path).where("kind = 'record'").select(
        page_number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", page_number(F.col("refers_to")).alias("refers_to"),
    )
