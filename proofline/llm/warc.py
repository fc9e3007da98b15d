"""WARC archives: writing with segmented records and revisits, reading with segment reassembly.

Writing. Every row becomes a record whose block is an HTTP response with a chunked body. A block above ``segment_bytes``
is cut into a first segment and ``continuation`` records that name the first one's id, their number and, in the last,
the total length. Of rows with equal payloads (of at least ``revisit_from`` bytes) the one with the smallest id keeps
the payload, the others become ``revisit`` records. The archives are written by Spark's text writer with the record
separator of the format (two line ends) as line separator, so they land in any store Spark can write.

Reading. Files are parsed record by record in Arrow batches. Whole records are decoded where they lie. Segments, which
are few, are grouped by origin, counted once per (origin, number) before the shuffle so that repeated rows cost nothing,
ordered by number, checked for gaps and total length, joined, and then the chunk framing is decoded.

Rows repeating the id and payload of the response are responses too. A null id is a record without id and is a
response only if no row with an id has its payload. A null or empty text is an empty payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

CRLF = b"\r\n"
END = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORDS_PER_FILE = 2000
_RECORD = ("id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
           "origin string, number int, total bigint, block binary, error string")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: four groups of ten hexadecimal digits, eight letters each."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def python_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plan_records(pages: DataFrame, revisit_from: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, url, payload, digest, size, refers_to (null for responses).

    Only payloads that occur more than once are joined back, from a written table, so that the planner sees their true
    size and splits a hot payload.
    """
    rows = pages.select(F.col(page_id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.encode(F.col(html), "utf-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload").cast("bigint")})
    repeated = (rows.groupBy("digest", "size").agg(F.min("id").alias("first"), F.count("*").alias("n"))
                .filter((F.col("n") > 1) & (F.col("size") >= revisit_from) & F.col("first").isNotNull()))
    repeated = staged(repeated.select(F.col("digest").alias("d"), F.col("size").alias("s"), "first"), "repeated")
    joined = rows.join(repeated, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("id", "url", "digest", "size", refers.alias("refers_to"),
                         F.when(refers.isNull(), F.col("payload")).alias("payload"))


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    parts = []
    for at in range(0, len(payload), chunk_bytes):
        piece = payload[at:at + chunk_bytes]
        parts += [b"%x" % len(piece), CRLF, piece, CRLF]
    return b"".join([*parts, b"0", END])


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; extensions after a chunk size are skipped, broken framing is an error."""
    parts, at = [], 0
    while True:
        line = body.index(CRLF, at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if n == 0:
            return b"".join(parts)
        if n < 0 or body[at + n:at + n + 2] != CRLF:
            raise ValueError("broken chunk framing")
        parts.append(body[at:at + n])
        at += n + 2


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1"] + [f"{k}: {v}" for k, v in fields if v is not None]
    return "\r\n".join(lines).encode() + END


def _records(page: int | None, url: str | None, digest: str, size: int, refers: int | None, payload: bytes | None,
             segment_bytes: int, chunk_bytes: int, date: str) -> Iterator[bytes]:
    url = "".join((url or "").split())
    common = [("WARC-Date", date), ("WARC-Target-URI", url or None), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("X-Page-Id", page), ("X-Payload-Bytes", size)]
    own = _record_id(page, digest)
    if refers is not None:
        head = HTTP_HEAD
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common,
                     ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                     ("WARC-Refers-To", _record_id(refers, digest)), ("X-Refers-To-Page-Id", refers),
                     ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(head))]) + head
        return
    block = HTTP_HEAD + chunked(payload or b"", chunk_bytes)
    cuts = range(0, len(block), segment_bytes)
    for k, at in enumerate(cuts, 1):
        piece = block[at:at + segment_bytes]
        fields = [("WARC-Type", "response" if k == 1 else "continuation"),
                  ("WARC-Record-ID", own if k == 1 else _record_id(page, f"{digest}#{k}")), *common]
        if len(cuts) > 1:
            fields.append(("WARC-Segment-Number", k))
            if k > 1:
                fields.append(("WARC-Segment-Origin-ID", own))
            if k == len(cuts):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(piece))]
        yield _head(fields) + piece


def write_archives(planned: DataFrame, path: str, segment_bytes: int = 32768, chunk_bytes: int = 8192,
                   date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes gzip-compressed archives below ``path``; a file holds at most ``RECORDS_PER_FILE`` records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):
                for record in _records(*(batch.column(k)[i].as_py() for k in range(6)), segment_bytes, chunk_bytes, date):
                    out.append(record)
                    held += len(record)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = planned.select("id", "url", "digest", "size", "refers_to", "payload").mapInArrow(run, "value binary")
    (records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode())
     .option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview | None]]:
    """Header fields (names in lower case) and block of every record; blank lines between records are skipped.

    Where no whole record stands, a pair ({"error": reason}, None) comes instead, and reading goes on at the next
    ``WARC/`` that follows an empty line.
    """
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at:at + 2] == CRLF:
            at += 2
            continue
        stop = data.find(END, at) if data.startswith(b"WARC/", at) else -1
        fields = {}
        for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:] if stop >= 0 else ():
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        n = int(size) if size.isascii() and size.isdigit() else -1
        if n >= 0 and stop + 4 + n <= len(data):
            yield fields, view[stop + 4:stop + 4 + n]
            at = stop + 4 + n
            continue
        yield {"error": "no record" if stop < 0 else "no length" if n < 0 else "record cut off", "at": str(at)}, None
        further = data.find(END + b"WARC/", at)
        at = len(data) if further < 0 else further + 4


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    head, _, body = block.partition(END)
    is_chunked = any(x.lower().startswith(b"transfer-encoding:") and b"chunked" in x.lower() for x in head.split(CRLF)[1:])
    return dechunked(body) if is_chunked else body


def _inflate(data: bytes) -> tuple[bytes, str | None]:
    """Content of an archive, gzip or plain, and what is wrong with its compression; what comes before the fault is kept."""
    if data[:2] != b"\x1f\x8b":
        return data, None
    out = []
    while data:  # archives may hold one gzip member per record
        member = zlib.decompressobj(31)
        for at in range(0, len(data), 1 << 16):
            try:
                out.append(member.decompress(data[at:at + (1 << 16)]))
            except zlib.error as e:
                return b"".join(out), f"damaged gzip data: {e}"
            if member.eof:
                break
        if not member.eof:
            return b"".join(out), "gzip data cut off"
        data = (member.unused_data + data[at + (1 << 16):]).lstrip(b"\0")
    return b"".join(out), None


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _row(f: dict[str, str], block: memoryview | None) -> list | None:
    """Values of ``_RECORD`` for a record, None for those that hold no page; ValueError if it is broken."""
    if block is None:
        raise ValueError(f"{f['error']} at byte {f['at']}")
    kind = f.get("warc-type")
    row = [_number(f.get("x-page-id")), f.get("warc-target-uri"), kind, _number(f.get("x-refers-to-page-id"))]
    digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        return row + [_number(f.get("x-payload-bytes")), digest, None, None, None, None, None]
    if "warc-segment-number" in f:
        return row + [None, digest, f.get("warc-segment-origin-id", f.get("warc-record-id")), int(f["warc-segment-number"]),
                      _number(f.get("warc-segment-total-length")), bytes(block), None]
    if kind == "response":
        payload = payload_of(bytes(block))
        return row + [len(payload), python_digest(payload), None, None, None, None, None]
    return None  # warcinfo, request, metadata


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``_RECORD``; unsegmented records are decoded and carry no block. A file must fit in a task.

    A broken record or archive gives a row of record_type ``error`` with the file and the reason in ``error``; the
    records around it are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("origin", pa.string()),
                            ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, fault = _inflate(content.as_py())
                rows = [_error(None, None, f"{name}: {fault}")] if fault else []
                for f, block in parse_records(data):
                    try:
                        row = _row(f, block)
                    except ValueError as e:
                        page = f.get("x-page-id", "")
                        row = _error(int(page) if page.isascii() and page.isdigit() else None, f.get("warc-target-uri"), f"{name}: {e}")
                    if row:
                        rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [()] * 11, schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, _RECORD)


def _error(page: int | None, url: str | None, reason: str) -> list:
    return [page, url, "error", None, None, None, None, None, None, None, reason]


def reassemble(records: DataFrame) -> DataFrame:
    """Segmented records joined: one row per origin and copy.

    A gap, a wrong total length or a wrong digest gives a row of record_type ``error`` with the reason.
    """
    once = records.filter("origin IS NOT NULL").groupBy("origin", "number").agg(
        F.count("*").alias("copies"), *[F.first(c, ignorenulls=True).alias(c) for c in ("id", "url", "refers_to", "payload_digest", "total", "block")])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        numbers, totals = table["number"].to_pylist(), [t for t in table["total"].to_pylist() if t is not None]
        block = b"".join(table["block"].to_pylist())
        reason = digest = size = None
        if numbers != list(range(1, len(numbers) + 1)) or totals != [len(block)]:
            reason = f"incomplete record {table['origin'][0]}: segments {numbers[:20]}, length {len(block)} of {totals}"
        else:
            try:
                payload = payload_of(block)
                size, digest = len(payload), python_digest(payload)
                if digest != table["payload_digest"][0].as_py():
                    reason, size, digest = f"digest of {table['origin'][0]} differs", None, None
            except ValueError as e:
                reason = f"record {table['origin'][0]}: {e}"
        return pa.table({"id": table["id"][:1], "url": table["url"][:1], "payload_bytes": pa.array([size], pa.int64()),
                         "payload_digest": pa.array([digest], pa.string()), "copies": pa.array([table["copies"][0].as_py()], pa.int64()),
                         "error": pa.array([reason], pa.string())})

    joined = once.groupBy("origin").applyInArrow(join, "id bigint, url string, payload_bytes bigint, payload_digest string, copies bigint, error string")
    each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return each.select("id", "url", F.when(F.col("error").isNull(), "response").otherwise("error").alias("record_type"),
                       F.lit(None).cast("bigint").alias("refers_to"), "payload_bytes", "payload_digest", "error")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: id, url, record_type, refers_to, payload_bytes, payload_digest, error (null for whole records).

    The parsed records are staged: the text of the archives is read and inflated once.
    """
    records = staged(read_records(spark, path), "records")
    whole = records.filter("origin IS NULL").select("id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "error")
    return whole.unionByName(reassemble(records))
