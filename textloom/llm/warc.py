"""WARC archives: writing with segmented records, and reading with segment reassembly.

Each page is an HTTP response with a chunked body. Of pages with equal payloads the one with the
smallest page_id is stored as a response record; the others are revisit records that name it. A
block over ``SEGMENT_BYTES`` is split: the first segment is the response record, the rest are
continuation records with its id as origin. The reader parses the archives, groups segments by
origin, orders them by number, verifies the total length and decodes the chunked framing.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._spark import durable, if_small, stored

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
ARCHIVE_BYTES = 4_000_000
_END = b"\r\n"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in HTTP/1.1 chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x" % len(piece), _END, piece, _END]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        line = body.index(_END, at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        begin = line + 2
        if body[begin + size : begin + size + 2] != _END:
            raise ValueError("damaged chunk")
        parts.append(body[begin : begin + size])
        at = begin + size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC/1.1 record; fields without a value are left out, and line ends in values are dropped."""
    lines = [b"WARC/1.1"]
    for name, value in [*fields, ("Content-Length", len(block))]:
        if value is not None:
            lines.append(f"{name}: {str(value).replace(chr(13), '').replace(chr(10), '')}".encode())
    return _END.join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


#: The date of all records: archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"


def page_records(page_id: int | None, url: str | None, payload: bytes | None, first: int | None, urn: str, said: str | None = None, first_url: str | None = None) -> list[bytes]:
    """The records of one page; ``first`` is the page (at ``first_url``) whose equal payload it revisits, if any.

    ``said`` is the payload's digest, which a revisit needs in place of its payload.
    """
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{said or digest(payload)}")]
    if first is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{urn}>"), *common, ("WARC-Refers-To-Target-URI", first_url), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", first)]
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [record([*fields, profile], b"HTTP/1.1 200 OK\r\n\r\n")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{urn}>"), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= SEGMENT_BYTES:
        return [record(fields, block)]
    parts = [block[at : at + SEGMENT_BYTES] for at in range(0, len(block), SEGMENT_BYTES)]
    out = [record([*fields, ("WARC-Segment-Number", 1)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        total = len(block) if number == len(parts) else None
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{urn}:{number}>"), ("WARC-Date", DATE)]
        out.append(record([*more, ("WARC-Segment-Origin-ID", f"<{urn}>"), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)], part))
    return out


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        begin = end + 4
        at = begin + int(fields["content-length"])
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError("damaged record")
        yield fields, archive[begin:at]
        at += 4


#: Keys over which one payload's copies are spread in a join.
SALTS = 16


def _salt(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")


def _salted(rows: DataFrame) -> DataFrame:
    """``rows`` once for each salt."""
    return rows.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """archive, warc: binary archives of some 4 MB with a record for each row of ``pages``.

    Payloads are compared by SHA-1, which Spark works out. Only groups of two or more are joined back, by
    broadcast where they are few and else over SALTS keys each; a copy goes to the writer without its
    payload. Null html counts as empty; a page of any length is cut into segments. A null page_id
    sorts after all others and keeps its own record; rows that repeat the smallest page_id of a payload
    are responses too. An empty table gives no archives. Other columns are ignored.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"),
    ).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    groups = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.min_by("url", F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first_url"), F.count(F.lit(1)).alias("n"))
    shared = if_small(durable(_salted(groups.filter("n > 1").select("sha1", "first", "first_url"))))
    rows = rows.withColumn("salt", _salt("page_id")).join(shared, ["sha1", "salt"], "left")
    copy = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    sent = rows.select("page_id", "url", F.when(~copy, F.col("html").cast("binary")).alias("html"), F.when(copy, F.col("first")).alias("first"), F.unhex("sha1").alias("sha1"), "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, records, size, n = TaskContext.get().partitionId(), [], 0, 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:09d}.warc"]), pa.array([b"".join(records)], pa.binary())], names=["archive", "warc"])

        for batch in batches:
            for page, address, payload, first, sha1, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                made = page_records(page, address, payload, first, f"urn:textloom:{task}:{n}", base64.b32encode(sha1).decode(), first_url)
                records += made
                size += sum(map(len, made))
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    records, size = [], 0
        if records:
            yield archive()

    return sent.mapInArrow(run, "archive string, warc binary")


_PARSED = pa.schema(
    [("origin", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()),
     ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary())]
)


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, payload_bytes: one row per response or revisit.

    A record that isn't segmented is decoded where it is parsed; its short row and the segments of
    others are shuffled, and what meets in a group is of one record. A response whose digest or total length doesn't
    fit raises ValueError. A revisit's payload_bytes are those of the response it refers to.
    """

    def number(fields: dict[str, str], name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for warc in batch.column(0):
                rows = []
                for fields, block in parse(warc.as_py()):
                    kind, own = fields["warc-type"], fields["warc-record-id"]
                    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    segment, size = number(fields, "warc-segment-number"), None
                    if kind == "response" and segment is None:
                        payload = payload_of(block)
                        if digest(payload) != said:
                            raise ValueError(f"{own}: the payload doesn't have its digest")
                        size = len(payload)
                    rows.append((fields.get("warc-segment-origin-id", own), kind, number(fields, "x-page-id"), number(fields, "x-refers-to-page-id"), said, size, segment, number(fields, "warc-segment-total-length"), block if segment else None))
                columns = zip(*rows, strict=True) if rows else [()] * len(_PARSED)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARSED, strict=True)], schema=_PARSED)

    records = archives.select("warc").mapInArrow(parsed, "origin string, kind string, page_id long, refers_to long, digest string, payload_bytes long, segment long, total long, block binary")
    whole = (
        records.groupBy("origin")
        .agg(
            *(F.max(F.when(F.col("kind") != "continuation", F.col(c))).alias(c) for c in ("kind", "page_id", "refers_to", "digest", "payload_bytes")),
            F.max("total").alias("total"),
            F.array_sort(F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "block")))).alias("segments"),
        )
        .select("kind", "page_id", "refers_to", "digest", "payload_bytes", "total", F.transform("segments", lambda s: s["segment"]).alias("numbers"), F.transform("segments", lambda s: s["block"]).alias("blocks"))
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for said, size, total, numbers, blocks in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
                if numbers:
                    block = b"".join(blocks)
                    if numbers != list(range(1, len(numbers) + 1)) or len(block) != total:
                        raise ValueError("segments are missing")
                    payload = payload_of(block)
                    if digest(payload) != said:
                        raise ValueError("the payload doesn't have its digest")
                    size = len(payload)
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64())], names=["kind", "page_id", "refers_to", "digest", "payload_bytes"])

    read = durable(whole.mapInArrow(joined, "kind string, page_id long, refers_to long, digest string, payload_bytes long"))
    sizes = read.filter("kind = 'response'").groupBy("digest").agg(F.max("payload_bytes").alias("known"))
    revisits = read.filter("kind = 'revisit'").withColumn("salt", _salt("page_id")).join(_salted(sizes), ["digest", "salt"], "left").select("kind", "page_id", "refers_to", "digest", F.col("known").alias("payload_bytes"))
    rows = read.filter("kind = 'response'").unionByName(revisits)
    return rows.select("page_id", F.col("kind").alias("record_type"), "refers_to", F.col("digest").alias("payload_digest"), "payload_bytes")


def archive_pages(pages: DataFrame, **columns: str) -> DataFrame:
    """Writes ``pages`` to stored archives, reads them back and returns one row per page."""
    return read_archives(stored(write_archives(pages, **columns)))
