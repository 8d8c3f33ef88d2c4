"""WARC archives: one gzip member per record, written by Spark's committed writer, read back by byte ranges.

Writing. Records of a partition are packed into archives of about ``ARCHIVE_BYTES``; an archive is one row,
and Spark's text writer, held to one row a file, writes it as it stands (tried with Spark 4.1). That writer
must end a row with something, so it ends each file with an empty gzip member, which adds no byte to the
decompressed stream.

Reading. Files are listed with their lengths and cut into byte ranges. A task looks in its range for the gzip
magic, decodes the header at each candidate and inflates its start; a candidate counts only if it is a
member that begins with a WARC version line. The task owns the records whose members start inside its range
and reads past the range's end where the last one needs it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, partitions

ARCHIVE_BYTES = 16 << 20
RANGE_BYTES = 8 << 20
#: Bytes that a task holds of a file at once while it looks for members.
WINDOW_BYTES = 1 << 20

# Fixed values of the formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, payload binary, path string, offset long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def gzip_member(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone; both headers tell the full payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%-._~''')}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload`` and ``refers_to`` (null: the record is a response).

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the response. Rows with that same id
    are responses as well; a null id counts as larger than any other.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = rows.filter(F.octet_length("payload") >= min_bytes).groupBy(F.col("digest").alias("first_digest")).agg(F.min("page_id").alias("first_id"))
    joined = rows.join(firsts, F.col("digest") == F.col("first_digest"), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", F.when(again, F.col("first_id")).alias("refers_to"))


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])

    for batch in batches:
        for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
            parts.append(gzip_member(record_bytes(page_id, url, payload, refers_to, refers_to is not None)))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield flush()
                parts, size = [], 0
    if parts:
        yield flush()


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as archives under ``path``; null html is an empty payload, a null URL leaves out the header line, an empty table writes no archive."""
    archives = with_revisits(pages, min_bytes).mapInArrow(_archives, "archive binary")
    writer = archives.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
    writer.option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def _header_end(data: bytes, at: int) -> int:
    """Where the deflate stream of a gzip header at ``at`` begins; -1: not a header; -2: more bytes are needed."""
    if len(data) < at + 10:
        return -2
    flags = data[at + 3]
    if flags & 0xE0:
        return -1
    end = at + 10
    if flags & 4:
        if len(data) < end + 2:
            return -2
        end += 2 + int.from_bytes(data[end : end + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            zero = data.find(b"\0", end)
            if zero < 0:
                return -2
            end = zero + 1
    end += 2 * bool(flags & 2)
    return end if len(data) >= end else -2


def _inflate(file, at: int, size: int) -> tuple[bytes, int] | None:
    """Content and end of the member at ``at``, or None if there is no whole member that begins with a WARC version."""
    unpack = zlib.decompressobj(31)
    out: list[bytes] = []
    seen, step, begun = at, 8 << 10, b""
    try:
        while not unpack.eof and seen < size:
            file.seek(seen)
            piece = file.read(min(step, size - seen))
            if seen == at and _header_end(piece, 0) == -1:
                return None
            seen, step = seen + len(piece), min(2 * step, 1 << 20)
            out.append(unpack.decompress(piece))
            if len(begun) < 5:
                begun += out[-1][:5]
                if not b"WARC/".startswith(begun[:5]):
                    return None
    except zlib.error:
        return None
    return (b"".join(out), seen - len(unpack.unused_data)) if unpack.eof and begun[:5] == b"WARC/" else None


def members(file, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the WARC members of an open file that start in [start, end)."""
    at, window_bytes = start, 1 << 10
    while at < end:
        file.seek(at)
        window = file.read(min(window_bytes, end - at) + 2)
        hit = window.find(GZIP_MAGIC)
        if hit < 0 or at + hit >= end:
            at, window_bytes = at + max(1, len(window) - 2), WINDOW_BYTES
            continue
        at += hit
        found = _inflate(file, at, size)
        if found is None:
            at += 1
        else:
            yield at, found[0]
            at, window_bytes = found[1], 1 << 10


def parse_record(content: bytes) -> tuple:
    """Fields of ``RECORD_SCHEMA`` up to the payload.

    Ids that are not of this writer's form give a null ``page_id``, and stay in ``record_id`` and
    ``refers_to_record``. A response's payload is what follows its HTTP header; a revisit has none, and its length
    and digest are those its headers tell, or null; of other types (warcinfo, request, metadata, ...) the
    whole block is the payload. A block cut short or without a length is what is there.
    """
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    told = re.fullmatch(r"\d+", fields.get("content-length", ""))
    block = rest[: int(told[0])] if told else rest.removesuffix(b"\r\n\r\n")
    own = lambda name: (m := re.fullmatch(r"<urn:page:(-?\d{1,19})>", fields.get(name, ""))) and (n if -(1 << 63) <= (n := int(m[1])) < 1 << 63 else None)
    kind, refers = fields.get("warc-type", "unknown").lower(), None
    length, digest, payload = len(block), None, block
    if kind == "response" and fields.get("content-type", "").lower().startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if kind == "revisit":
        found = re.search(rb"(?im)^content-length:\s*(\d+)", block.partition(b"\r\n\r\n")[0])
        length, payload, refers = int(found[1]) if found else None, None, own("warc-refers-to")
        digest = fields["warc-payload-digest"].rpartition(":")[2] if "warc-payload-digest" in fields else None
    else:
        length, digest = len(payload), sha1_base32(payload)
    return own("warc-record-id"), fields.get("warc-target-uri"), length, digest, kind, refers, fields.get("warc-record-id"), fields.get("warc-refers-to"), payload


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])
    for batch in batches:
        for path, size, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start", "end")), strict=True):
            system, name = pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)))
            rows, held = [], 0
            with system.open_input_file(name) as file:
                for offset, content in members(file, start, end, size):
                    rows.append((*parse_record(content), path, offset))
                    held += len(content)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all archives under ``path`` (``RECORD_SCHEMA``); an empty folder has none.

    A revisit has no payload, but the length and the digest of the payload it stands for. ``range_bytes``
    changes the number of tasks and no row. Executors open the archives with Arrow's file systems, by the
    scheme of the path.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / range_bytes)))
    ranges = files.filter("length > 0").select("path", "length", cut.alias("n")).select("path", "length", (F.col("n") * range_bytes).alias("start"), F.least(F.col("length"), (F.col("n") + 1) * range_bytes).alias("end"))
    return ranges.repartition(partitions(spark), "path", "start").mapInArrow(_read_ranges, RECORD_SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to the shared folder and return what the archives say of each page, without the payloads."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, min_bytes)
    kept: list[Column | str] = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read_warc(spark, path).select(*kept)
