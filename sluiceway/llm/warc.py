"""WARC archives written by Spark and read back record by record.

Every record is a gzip member of its own. Spark's text writer puts a line
separator after each row, so the separator is an empty gzip member: the
files are plain multi-member gzip, whole on any file system that Spark
writes to, under its commit protocol.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# payload bytes of one archive file, about
ARCHIVE_BYTES = 16 << 20

LEVEL = 6

# fixed values: an empty gzip member, and how records end
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff" "0300" "00000000" "00000000")
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard namespace of URLs


def digest32(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page/{page_id}')}>"


def _clean(value: str) -> bytes:
    """A header value holds no line breaks."""
    return value.replace("\r", "%0D").replace("\n", "%0A").encode("utf-8")


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"WARC/1.1" + CRLF + b"".join(
        name.encode("ascii") + b": " + _clean(value) + CRLF for name, value in headers
    )
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    parts = [packer.compress(head), packer.compress(CRLF), packer.compress(block)]
    return b"".join([*parts, packer.compress(CRLF + CRLF), packer.flush()])


def response_record(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    block = (
        b"HTTP/1.1 200 OK" + CRLF + b"Content-Type: text/html; charset=utf-8" + CRLF
        + b"Content-Length: " + str(len(payload)).encode() + CRLF + CRLF + payload
    )
    return _member(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", record_id(page_id)),
            *([] if page_id is None else [("X-Page-ID", str(page_id))]),
            ("WARC-Target-URI", url or ""),
            ("WARC-Date", "2024-01-01T00:00:00Z"),
            ("Content-Type", "application/http;msgtype=response"),
            ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
            ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
            ("Content-Length", str(len(block))),
        ],
        block,
    )


def revisit_record(page_id: int | None, url: str | None, digest: str, refers_to: int) -> bytes:
    block = b"HTTP/1.1 200 OK" + CRLF + CRLF
    return _member(
        [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", record_id(page_id)),
            *([] if page_id is None else [("X-Page-ID", str(page_id))]),
            ("WARC-Target-URI", url or ""),
            ("WARC-Date", "2024-01-01T00:00:00Z"),
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to)),
            ("X-Refers-To-Page-ID", str(refers_to)),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
            ("Content-Type", "application/http;msgtype=response"),
            ("Content-Length", str(len(block))),
        ],
        block,
    )


class DamagedArchive(ValueError):
    """A record whose framing or digest is wrong."""


def read_records(data: bytes, chunk: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of one archive, in order.

    Members are unpacked piece by piece; members of no bytes are passed over. The block is framed by
    Content-Length, must be followed by two line breaks and the member's end, and
    must have the block digest the record names.
    """
    at, view = 0, memoryview(data)
    while at < len(view):
        unpack, out = zlib.decompressobj(31), bytearray()
        while not unpack.eof:
            if at >= len(view):
                raise DamagedArchive("an archive ends inside a record")
            piece = view[at : at + chunk]
            try:
                out += unpack.decompress(piece)
            except zlib.error as error:
                raise DamagedArchive(str(error)) from error
            at += len(piece) - len(unpack.unused_data)
        if out:
            yield _parsed(bytes(out))


def _parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = record.partition(CRLF + CRLF)
    lines = head.split(CRLF)
    if not found or not lines[0].startswith(b"WARC/"):
        raise DamagedArchive("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("ascii")] = value.strip().decode("utf-8")
    length = int(headers["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != CRLF + CRLF:
        raise DamagedArchive(f"{headers.get('warc-record-id')}: Content-Length does not frame the block")
    named = headers.get("warc-block-digest")
    if named and named != f"sha1:{digest32(block)}":
        raise DamagedArchive(f"{headers.get('warc-record-id')}: wrong block digest")
    return headers, block


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page as a finished response record, before any shuffle."""
    for batch in batches:
        ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        pages = [p or "" for p in batch.column(2).to_pylist()]
        payloads = [p.encode("utf-8") for p in pages]
        rows = zip(ids, urls, payloads, strict=True)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([hashlib.sha1(p).hexdigest() for p in payloads], pa.string()),
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([response_record(*row) for row in rows], pa.binary()),
            ],
            names=["page_id", "url", "digest", "payload_bytes", "record"],
        )


def _revisited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Revisit records in place of the empty ones."""
    for batch in batches:
        ids, urls, digests, firsts, records = (c.to_pylist() for c in batch.columns)
        out = [
            record
            if record is not None
            else revisit_record(page, url, base64.b32encode(bytes.fromhex(digest)).decode(), first)
            for page, url, digest, first, record in zip(
                ids, urls, digests, firsts, records, strict=True
            )
        ]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def write_archives(
    pages: DataFrame,
    path: str,
    least_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write every page as a WARC record below ``path``.

    Of pages with equal payloads of at least ``least_bytes``, the one with the
    smallest id is a response and the others are revisits that refer to it;
    smaller payloads are all responses. A null page has an empty payload. Rows that repeat
    the smallest id are responses too. A page without an id is a revisit if
    its payload has a page with one, else a response.

    Records are packed where the pages are read, so that only compressed records
    are shuffled; the join that finds the first of equal payloads can split a hot one.
    """
    spark = pages.sparkSession
    packed = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    ).mapInArrow(
        _packed, "page_id long, url string, digest string, payload_bytes long, record binary"
    )
    # the digests again, natively, from the id and the page alone: no record is packed for them
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    sizes = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.sha1(html).alias("digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
    )
    firsts = (
        sizes.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    count, total = sizes.agg(F.count("*"), F.sum("payload_bytes")).first()
    records_per_file = max(1, ARCHIVE_BYTES * count // max(total or 0, 1))
    again = ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()
    (
        packed.join(firsts, "digest", "left")
        .select(
            "page_id", "url", "digest", "first",
            F.when(~again, F.col("record")).alias("record"),
        )
        .mapInArrow(_revisited, "record binary")
        # a string column is written byte for byte
        .select(F.col("record").cast("string").alias("value"))
        .write.option("encoding", "ISO-8859-1")
        .option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("maxRecordsPerFile", min(records_per_file, 1_000_000))
        .text(path)
    )


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("payload_digest", pa.string()),
            ("refers_to", pa.int64()),
            ("payload", pa.binary()),
        ]
    )

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
            schema=schema,
        )

    for batch in batches:
        for data in batch.column(0).to_pylist():
            rows, held = [], 0
            for headers, block in read_records(data):
                kind = headers["warc-type"]
                payload = block.partition(CRLF + CRLF)[2] if kind == "response" else None
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if payload is not None and digest != digest32(payload):
                    raise DamagedArchive(f"{headers['warc-record-id']}: wrong payload digest")
                page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                rows.append(
                    (
                        None if page is None else int(page),
                        headers["warc-target-uri"],
                        kind,
                        digest,
                        None if refers is None else int(refers),
                        payload,
                    )
                )
                held += len(payload or b"")
                if held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read_archives(spark, path: str) -> DataFrame:
    """``page_id, url, record_type, payload_digest, refers_to, payload`` of all records below ``path``.

    A torn record or a wrong digest stops the read. A file is one task's
    work and holds about ARCHIVE_BYTES of payload.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(
        _unpacked,
        "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary",
    )


def archived_pages(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, revisits resolved.

    A revisit takes its size from the response it refers to, which must have the same digest.
    """
    seen = records.select(
        "page_id", "record_type", "payload_digest", "refers_to",
        F.octet_length("payload").cast("long").alias("own_bytes"),
    )
    sizes = (
        seen.where("record_type = 'response'")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("own_bytes").alias("first_bytes"))
    )
    return seen.join(sizes, ["refers_to", "payload_digest"], "left").select(
        "page_id",
        F.coalesce("own_bytes", "first_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )
